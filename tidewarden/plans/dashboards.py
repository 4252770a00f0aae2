"""The operational questions over the event table. ``now`` is always a parameter."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def is_dns():
    return F.col("event_type") == "dns"


def filtered(events: DataFrame, classification: str | None = None, decision: str | None = None, query: str | None = None, event_type: str | None = None) -> DataFrame:
    """Conjunction of the filters given. ``query`` is a case-insensitive pattern inside the name; its % and _ are wildcards."""
    if event_type:
        events = events.where(F.col("event_type") == event_type.lower())
    if classification:
        events = events.where(F.col("classification") == classification.upper())
    if decision:
        events = events.where(F.col("decision") == decision.upper())
    if query and query.strip():
        events = events.where(F.col("domain").ilike(f"%{query.strip().lower()}%"))
    return events


def list_events(events: DataFrame, limit: int = 50, offset: int = 0, **filters: str | None) -> DataFrame:
    """One page, newest first."""
    return filtered(events, **filters).orderBy(F.desc("id")).offset(max(0, offset)).limit(min(500, max(1, limit)))


def get_event(events: DataFrame, event_id: int) -> DataFrame:
    return events.where(F.col("id") == event_id).limit(1)


def counted(events: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Rows (column, n), most frequent first; ``keys`` come with 0 where they don't occur."""
    counts = events.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if keys:
        every = events.sparkSession.createDataFrame([(k,) for k in keys], f"{column} string")
        counts = every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
    return counts.orderBy(F.desc("n"), column)


def timing(events: DataFrame) -> DataFrame:
    return events.agg(*(F.round(F.coalesce(f("analysis_time_ms"), F.lit(0.0)), 3).alias(n) for n, f in (("mean_ms", F.avg), ("fastest_ms", F.min), ("slowest_ms", F.max))))


#: Rows up to which a bracket of a percentile is sorted.
SORTED_ROWS = 50_000


def floor_percentile(rows: DataFrame, column: str, fraction: float) -> float:
    """The element at floor(n * fraction) of the sorted non-null values; 0 when there are none.

    Approximate quantiles bracket it more closely with each pass, about a hundredfold, until few rows are left to sort."""
    x = F.col(column)
    rows = rows.where(x.isNotNull())
    n, low, high = rows.agg(F.count(x), F.min(x), F.max(x)).first()
    k, inside, below = int(n * fraction), n, 0
    while low != high and inside > SORTED_ROWS:
        share = (k - below) / inside
        near = rows.where(x.between(low, high)).agg(F.percentile_approx(x, [max(0.0, share - 0.005), min(1.0, share + 0.005)], 10000)).first()[0]
        less, some = rows.agg(F.count_if(x < near[0]), F.count_if(x.between(*near))).first()
        if not less <= k < less + some or some == inside:  # a miss, or no closer
            break
        (low, high), below, inside = near, less, some
    if not n or low == high:
        return low if n else 0.0
    # Few values are left, or few rows: values are counted, and the counts added up in order.
    counts = rows.where(x.between(low, high)).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy("x").select("x", F.sum("n").over(Window.orderBy("x")).alias("upto")).where(F.col("upto") > k - below).orderBy("x").first()[0]


def risk_histogram(events: DataFrame) -> DataFrame:
    """Ten buckets, empty ones too; 100 belongs to the last."""
    bucket = F.least(F.floor(F.col("risk_score") / 10), F.lit(9)).cast("long")
    counts = events.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = events.sparkSession.range(10).withColumnRenamed("id", "bucket")
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def top_risky(events: DataFrame, k: int = 10, least: int = 30) -> DataFrame:
    """Domains by their highest risk, with the classification of the row that has it."""
    rows = events.where(F.col("risk_score") >= least).groupBy("domain")
    out = rows.agg(F.max("risk_score").alias("risk_score"), F.max_by("classification", F.struct("risk_score", "id")).alias("classification"), F.count(F.lit(1)).alias("hits"))
    return out.orderBy(F.desc("risk_score"), F.desc("hits"), "domain").limit(k)


#: What the codes of factors say in a few words.
LABELS = {
    "TI_MALICIOUS": "listed as malicious", "TI_SUSPICIOUS": "listed as suspicious", "DGA_HIGH": "looks generated", "DGA_MODERATE": "may be generated", "DNS_TUNNEL_INDICATORS": "may carry data", "BEHAVIORAL_ANOMALY": "odd history",
    "BRAND_IMPERSONATION": "imitates a brand", "BRAND_SUBSTRING": "contains a brand", "SUSPICIOUS_TLD": "suffix with much abuse", "SUSPICIOUS_KEYWORD": "words of phishing names", "PUNYCODE": "letters beyond ASCII", "ENTROPY_HIGH": "high entropy",
    "ENTROPY_VERY_HIGH": "very high entropy", "ENTROPY_NORMALIZED_HIGH": "hardly a repeated letter", "DIGIT_RATIO_HIGH": "many digits", "DIGIT_RATIO_VERY_HIGH": "mostly digits", "LENGTH_LONG": "long name", "LENGTH_VERY_LONG": "very long name",
    "HYPHEN_MANY": "many hyphens", "SUBDOMAIN_DEEP": "many levels", "CONSONANT_RUN_LONG": "hard to pronounce", "VOWEL_RATIO_LOW": "few vowels", "NO_DICTIONARY_WORDS": "no known words",
}


def first_label(factors):
    """What the strongest factor says: its label, or its code if that has none."""
    code = F.get(factors, F.lit(0))["code"]
    labels = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(labels, code), code, F.lit("no dominant factor"))


def top_blocked(events: DataFrame, k: int = 15) -> DataFrame:
    """Blocked names, with type, reason and policy of the row of highest risk."""
    rows = events.where(is_dns() & F.col("blocked")).groupBy("domain")
    best = F.max_by(F.struct("query_type", "top_factors", "block_policy"), F.struct("risk_score", "id"))
    out = rows.agg(F.max("risk_score").alias("risk_score"), best.alias("b"), F.count(F.lit(1)).alias("hits"))
    out = out.select("domain", "risk_score", "b.query_type", first_label(F.col("b.top_factors")).alias("reason"), F.col("b.block_policy").alias("policy"), "hits")
    return out.orderBy(F.desc("hits"), F.desc("risk_score"), "domain").limit(k)


def categories(events: DataFrame) -> DataFrame:
    rows = events.where(F.size("ti_categories") > 0).select(F.explode("ti_categories").alias("category")).where("category <> 'allowlisted'")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def hourly(events: DataFrame, column: str, values: list[str], now: datetime.datetime, hours: int = 24) -> DataFrame:
    """Counts by hour and value of the last hours; hours without rows are left out."""
    start = now.replace(microsecond=0) - datetime.timedelta(hours=hours)
    rows = events.where(F.col("ts") >= F.lit(start)).groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("hour"))
    return rows.pivot(column, values).agg(F.count(F.lit(1))).fillna(0)


def source_stats(events: DataFrame, k: int = 50) -> DataFrame:
    rows = events.where("client_address is not null").groupBy("client_address")
    out = rows.agg(
        F.count(F.lit(1)).alias("queries"), F.count_distinct("domain").alias("domains"), F.count_if("blocked").alias("blocked"),
        F.count_if(F.col("decision") == "MONITOR").alias("monitored"), F.max("risk_score").alias("max_risk"), F.max("ts").alias("last_seen"),
    )
    out = out.withColumn("threat_rate", F.round(100 * F.col("blocked") / F.col("queries"), 1))
    return out.orderBy(F.desc("blocked"), F.desc("queries"), "client_address").limit(k)


def totals(events: DataFrame) -> DataFrame:
    """All single-number measures from one scan."""
    c, own = F.count_if, F.col
    return events.agg(
        F.count(F.lit(1)).alias("events"), c(is_dns()).alias("dns_events"), c(own("classification").isin("SUSPICIOUS", "MALICIOUS")).alias("threats"),
        c(own("cache_hit")).alias("cache_hits"), c(is_dns() & own("client_address").isNull()).alias("unattributed"),
        c(own("total_gateway_time_ms").isNotNull()).alias("measured_queries"),
        F.round(F.coalesce(F.avg(F.when(own("upstream_used") & ~own("cache_hit"), own("dns_upstream_time_ms"))), F.lit(0.0)), 3).alias("mean_upstream_ms"),
        F.round(F.coalesce(F.avg(F.when(is_dns(), own("total_gateway_time_ms"))), F.lit(0.0)), 3).alias("mean_gateway_ms"),
        F.round(F.coalesce(F.max(F.when(is_dns(), own("total_gateway_time_ms"))), F.lit(0.0)), 3).alias("slowest_gateway_ms"),
    )


def log_lines(events: DataFrame) -> DataFrame:
    """What a log shows: severity, action and source of each row."""
    severity = F.when(F.col("decision") == "BLOCK", "BLOCKED").when(F.col("response_code") == "SERVFAIL", "ERROR").when(F.col("decision") == "MONITOR", "WARNING").otherwise("INFO")
    action = F.when(F.col("blocked"), "blocked").when(F.col("cache_hit"), "answered from cache").when(F.col("upstream_used"), "resolved upstream").otherwise("analysed")
    return events.select("id", "ts", "domain", severity.alias("severity"), action.alias("action"), F.coalesce("client_address", F.when(is_dns(), "unattributed").otherwise("analysis")).alias("source"))


def loopback_only(client, mode: str = "none"):
    """Client addresses as the privacy mode lets them be stored: none, loopback_only or always."""
    local = client.startswith("127.") | (client == "::1")
    return {"always": client, "loopback_only": F.when(local, client)}.get(mode, F.lit(None).cast("string"))


def gateway_outcome(decision, readable=None, has_question=None, is_query=None, error_code=None, cached=None, upstream_rcode=None, policy_rcode: str = "NXDOMAIN"):
    """struct(rcode, blocked, from_cache, logged) of a query: FORMERR if unreadable or without a question, NOTIMP for other
    operations, REFUSED (and counted as blocked, but not logged) for names that can't be judged, the policy's answer if
    blocked; else the cached answer, the upstream's, or SERVFAIL if there is none. Columns not given: all is well."""
    if policy_rcode not in ("NXDOMAIN", "REFUSED"):
        raise ValueError(f"no such block policy: {policy_rcode}")
    yes, none = F.lit(True), F.lit(None).cast("string")
    readable, has_question, is_query = (F.coalesce(yes if x is None else x, F.lit(False)) for x in (readable, has_question, is_query))
    invalid = F.lit(False) if error_code is None else error_code.isNotNull()
    hit = F.lit(False) if cached is None else F.coalesce(cached, F.lit(False))
    judged = readable & has_question & is_query & ~invalid
    rcode = (
        F.when(~readable | ~has_question, "FORMERR").when(~is_query, "NOTIMP").when(invalid, "REFUSED").when(decision == "BLOCK", policy_rcode)
        .when(hit, "NOERROR").otherwise(F.coalesce(none if upstream_rcode is None else upstream_rcode, F.lit("SERVFAIL")))
    )
    blocked = readable & has_question & is_query & (invalid | (decision == "BLOCK"))
    return F.struct(rcode.alias("rcode"), blocked.alias("blocked"), (judged & hit & (decision != "BLOCK")).alias("from_cache"), judged.alias("logged"))


def shares(events: DataFrame, column: str) -> DataFrame:
    """Rows (column, n, share): counts and percentages of all, most frequent first."""
    counts = events.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(100 * F.col("n") / F.col("_total"), 1).alias("share")).orderBy(F.desc("n"), column)


def reason(verdict, codes):
    """The shortest true statement on why a name was blocked or watched, by precedence."""
    return (
        F.when(verdict == "MALICIOUS", "listed as malicious").when(F.array_contains(codes, "DNS_TUNNEL_INDICATORS"), "possible tunnel").when(F.array_contains(codes, "BEHAVIORAL_ANOMALY"), "odd behaviour")
        .when(F.array_contains(codes, "DGA_HIGH"), "generated name").when(F.array_contains(codes, "BRAND_IMPERSONATION"), "imitates a brand").when(verdict == "SUSPICIOUS", "listed as suspicious").otherwise("score over the bar")
    )

"""Queries over stored models, registered detectors, events of several ages and the interface's view of them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions.features import shown
from tidewarden.functions.names import canonicalize
from tidewarden.operators import detectors, fusion, intel, models, scorers, training
from tidewarden.plans import analysis
from tidewarden.plans.feeds_catalog import ORACLE_SQL as FEEDS
from tidewarden.plans.feeds_catalog import evidence
from tidewarden.plans.names_catalog import FEATURES_SQL
from tidewarden.plans.names_catalog import hosts as asked_hosts
from tidewarden.plans.views import DNS_EVENTS_SQL, PAGE_HOSTS_SQL, dns_events, page_hosts
from tidewarden.shared import settle, shared_folder
from tidewarden.sources import event_store, schema_history


def _stored_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model trained on the labels of the pages' hosts, from a file of them, stored as the second version and read back."""
    path = shared_folder(spark, "model")
    lines = page_hosts(spark, sf_dir).select(F.replace("raw", F.lit("."), F.lit(" ")).alias("value"))
    spark.range(1).select(F.lit("# hosts").alias("value")).unionByName(lines).write.text(f"{path}/corpus")
    labels = settle(models.corpus(spark, f"{path}/corpus"), "labels")
    trained = models.train(labels)
    for _ in range(2):
        models.save(spark, trained, f"{path}/models")
    model = models.load(spark, f"{path}/models")
    scored = labels.select("label", F.round(scorers.bigram_llr(F.col("label"), model["log_probs"], model["uniform"], digits=True), 6).alias("score"))
    return scored.withColumns({c: F.round(F.lit(float(model[c])), 6) for c in ("mean", "std", "min", "max")} | {c: F.lit(int(model[c])).cast("long") for c in ("corpus_size", "version")})


def second_opinion(df: DataFrame) -> DataFrame:
    """A detector for the test events: the later letter of a host's number, the higher."""
    k = F.regexp_extract("domain", r"^h(\d+)\.", 1).cast("int")
    signal = F.struct(F.lit("numbers").alias("name"), (k * 9).cast("double").alias("score"), F.when(k % 4 == 0, 0.0).otherwise(0.5).alias("confidence"), F.lit("host_number").alias("scope_key"), F.lit("SCORED").alias("verdict"), F.array().alias("factors"))
    return df.withColumn("numbers", signal.cast(scorers.SIGNAL))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events judged by their risk and by a detector that is registered for this query."""
    detectors.register(spark, detectors.Detector("numbers", second_opinion, 0.2, "2", "numbers in host names"))
    try:
        rows = evidence(dns_events(spark, sf_dir))
        none = {n: F.lit(None).cast(scorers.SIGNAL) for n in fusion.SIGNALS if n not in rows.columns}
        for d in detectors.beside(spark):
            rows = d.add(rows)
        out = fusion.assess(rows.withColumns(none), weights=detectors.weights(spark))
    finally:
        detectors.unregister(spark, "numbers")
    a = F.col("assessment")
    own = F.aggregate(F.filter(a["factors"], lambda f: f["signal"] == "numbers"), F.lit(0.0), lambda t, f: t + f["contribution"])
    return out.select("id", a["score"].alias("score"), F.round(a["raw_score"], 6).alias("raw_score"), a["decision"].alias("decision"), F.round(a["coverage"], 6).alias("coverage"), F.round(own, 6).alias("numbers"), F.array_join(a["overrides"], ",").alias("overrides"))


def _evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored at three ages: before there was a client, with numbers that were narrower, and as they are."""
    path, e = shared_folder(spark, "ages"), dns_events(spark, sf_dir)
    e.where("id % 3 = 0").select("id", "domain", "risk_score").write.parquet(f"{path}/age=0")
    e.where("id % 3 = 1").select(F.col("id").cast("int").alias("id"), "domain", "risk_score", "client_address").write.parquet(f"{path}/age=1")
    e.where("id % 3 = 2").select("id", "domain", "risk_score", "client_address", "decision").write.parquet(f"{path}/age=2")
    rows = schema_history.read_evolved(spark, path, "id bigint, domain string, risk_score bigint, client_address string")
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("events"), F.sum("id").alias("ids"), F.max("risk_score").alias("max_risk"), F.count("client_address").alias("attributed"))


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "events")
    event_store.append(dns_events(spark, sf_dir), path, 0)
    out = event_store.projected(event_store.read(spark, path))
    return out.select("timestamp", "domain", "registrable_domain", "risk_score", "decision", "threat_intelligence_verdict", F.array_join("threat_categories", ",").alias("threat_categories"), "matched_indicator", F.size("top_factors").alias("factors"), "event_type", "blocked", "cache_hit", "response_code", "block_policy", "client_address")


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shown(analysis.features(asked_hosts(spark, sf_dir)))
    return out.select("domain", "digit_ratio", "vowel_ratio", "entropy", "sld_entropy", "normalized_entropy", "coverage", "tld_weight", "keyword_weight", F.col("length").cast("long").alias("length"))


def _url_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' urls, as they are and spoilt in many ways, as raw input."""
    host = F.regexp_extract("url", r"^.*?://([^/?#]*)", 1)
    forms = [
        F.col("url"), F.concat(F.lit(' "'), host, F.lit('." ')), F.concat(F.lit("me@"), host, F.lit(":8443")), F.concat(F.lit("<"), F.upper(host), F.lit(">")), F.concat(host, F.lit("..")), F.concat(F.lit("-"), host), F.concat(F.lit("a..") , host),
        F.repeat(host, 100), F.repeat(F.lit("x"), 64 + F.length(host)), F.concat(host, F.lit(".7")), F.concat(F.lit("two words."), host), F.lit(" "), F.concat(F.lit("ftp://"), F.lit("")), F.concat(F.lit("u_"), host, F.lit("/p?q#f")), F.array_join(F.array_repeat(F.lit("c" * 49), 5), "."),
    ]
    raw = F.element_at(F.array(*forms), (F.col("page_id") % len(forms) + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("i"), raw.alias("raw"))
    return canonicalize(rows).select("i", "name.domain", "name.error_code", "name.was_url")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a list made of the pages' hosts."""
    n = F.col("pages")
    rows = page_hosts(spark, sf_dir).select(
        F.col("raw").alias("indicator"), F.when(n > 5, "MALICIOUS").otherwise("SUSPICIOUS").alias("verdict"), F.when(n % 2 == 0, F.array(F.lit("spam"))).otherwise(F.array(F.lit("spam"), F.lit("phishing"))).alias("categories"), F.lit(0.9).alias("confidence"), n
    )
    return intel.statistics(rows.where("pages > 1"), rows.where("pages = 1").select(F.col("indicator").alias("domain")))


def queries() -> dict:
    return {"stored_model": _stored_model, "fused_detectors": _fused, "evolved_events": _evolved, "event_projection": _projected, "shown_features": _shown, "url_errors": _url_errors, "listed_hosts": _listed}


_HOST = "regexp_extract(url, '^.*?://([^/?#]*)', 1)"
_FORMS = f"""[url, ' "' || h || '." ', 'me@' || h || ':8443', '<' || upper(h) || '>', h || '..', '-' || h, 'a..' || h, repeat(h, 100), repeat('x', 64 + length(h)), h || '.7', 'two words.' || h, ' ', 'ftp://', 'u_' || h || '/p?q#f', '{".".join(["c" * 49] * 5)}']"""
ORACLE_SQL = {
    "stored_model": f"""
        with {PAGE_HOSTS_SQL}, labels as (select distinct unnest(string_split(raw, '.')) as label from hosts),
        corpus as (select label, '^' || regexp_replace(label, '[^a-z0-9-]', '', 'g') || '$' as s from labels),
        counts as (select s[i] as prev, s[i + 1] as next, count(*) as n from corpus, range(1, 80) r(i) where i < length(s) group by 1, 2), sums as (select prev, sum(n) as total from counts group by 1),
        grid as (
            select a.c || b.c as pair, ln((coalesce(n, 0) + 0.1) / (coalesce(total, 0) + 0.1 * 38)) as log_prob from (select unnest(string_split('^{training.ALPHABET}', '')) as c) a cross join (select unnest(string_split('{training.ALPHABET}$', '')) as c) b
            left join counts c on a.c = c.prev and b.c = c.next left join sums t on a.c = t.prev
        ), scores as (select label, avg(log_prob) - ln(1 / 38) as x from corpus, range(1, 80) r(i) join grid on pair = s[i] || s[i + 1] where i < length(s) group by 1)
        select label, round(x, 6) as score, round(avg(x) over (), 6) as mean, round(stddev_pop(x) over (), 6) as std, round(min(x) over (), 6) as min, round(max(x) over (), 6) as max, count(*) over () as corpus_size, 2::bigint as version from scores""",
    "fused_detectors": f"""
        with {DNS_EVENTS_SQL}, hosts_k as (select id, risk_score, regexp_extract(domain, '^h(\\d+)\\.', 1)::int as k from v_dns),
        votes as (select id, 0.25 * 0.85 as wl, risk_score::double as ls, case when k % 4 = 0 then 0 else 0.2 * 0.5 end as wn, (k * 9)::double as ns from hosts_k),
        summed as (select *, (wl * ls + wn * ns) / (wl + wn) as base, ls >= 70 and wn > 0 and ns >= 70 as two from votes), z as (select *, greatest(0, least(100, base + case when two then 8 else 0 end)) as raw from summed)
        select id, round_even(raw, 0)::int as score, round(raw, 6) as raw_score, case when round_even(raw, 0) < 30 then 'ALLOW' when round_even(raw, 0) < 70 then 'MONITOR' else 'BLOCK' end as decision,
            round((wl + wn) / (0.4 + 0.35 + 0.25 + 0.15 + 0.1 + 0.2), 6) as coverage, round(wn * ns / (wl + wn), 6) as numbers, case when two then 'corroboration_bonus' else '' end as overrides from z""",
    "evolved_events": f"with {DNS_EVENTS_SQL} select domain, count(*) as events, sum(id)::bigint as ids, max(risk_score)::bigint as max_risk, count(client_address) filter (where id % 3 > 0) as attributed from v_dns group by 1",
    "event_projection": f"""with {DNS_EVENTS_SQL} select ts as timestamp, domain, registrable_domain, risk_score, decision, ti_verdict as threat_intelligence_verdict, array_to_string(ti_categories, ',') as threat_categories, null::varchar as matched_indicator, len(top_factors)::int as factors,
        event_type, blocked, cache_hit, response_code, block_policy, client_address from v_dns""",
    "shown_features": f"""with recursive {FEATURES_SQL} select raw as domain, round(digit_ratio, 3) as digit_ratio, round(vowel_ratio, 3) as vowel_ratio, round(entropy, 3) as entropy, round(sld_entropy, 3) as sld_entropy, round(normalized_entropy, 3) as normalized_entropy,
        round(coverage, 3) as coverage, round(tld_weight, 2) as tld_weight, round(keyword_weight, 2) as keyword_weight, length(raw) as length from weighed""",
    "url_errors": "with p as (select page_id as i, url, " + _HOST + f" as h from pages), r as (select i, ({_FORMS})[i % 15 + 1] as raw from p)," + FEEDS["name_errors"].split("t(i, raw)),", 1)[1],
    "listed_hosts": f"""with {PAGE_HOSTS_SQL}, i as (select raw, case when pages > 5 then 'MALICIOUS' else 'SUSPICIOUS' end as verdict, case when pages % 2 = 0 then ['spam'] else ['spam', 'phishing'] end as categories from hosts where pages > 1)
        select 'verdict' as what, verdict as name, count(*) as n from i group by 2 union all select 'verdict', 'TRUSTED', count(*) from hosts where pages = 1 having count(*) > 0 union all select 'category', c, count(*) from (select unnest(categories) as c from i) group by 2""",
}

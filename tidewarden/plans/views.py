"""DNS-shaped views of the test tables, by the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.operators.fusion import band


FACTORS = "array<struct<code:string,severity:string,contribution:double>>"


def dns_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table: one row for each decision."""
    return as_dns(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_dns(events: DataFrame) -> DataFrame:
    """Raw events, stored or streamed, as decisions on names."""
    e = events.select("event_id", "ts", "user_id", F.col("event_type").alias("source_type"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    dns = F.col("source_type") != "signup"
    e = e.withColumn("risk_score", F.least(F.lit(100), F.floor("value").cast("int")))
    e = e.withColumns({"classification": band(F.col("risk_score").cast("double"), 0), "decision": band(F.col("risk_score").cast("double"), 1)})
    registrable = F.concat(F.lit("d"), (F.col("user_id") % 25).cast("string"), F.lit(".test"))
    blocked = (F.col("decision") == "BLOCK") & dns
    served = dns & (F.col("decision") != "BLOCK")
    upstream = served & (F.col("k") % 3 != 0)
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("k") % n + 1).cast("int"))
    categories = F.element_at(F.array(F.array(F.lit("malware"), F.lit("phishing")), F.array(F.lit("allowlisted"), F.lit("spam")), F.array().cast("array<string>")), (F.col("k") % 3 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), "ts", F.concat(F.lit("h"), (F.col("k") % 12).cast("string"), F.lit("."), registrable).alias("domain"),
        registrable.alias("registrable_domain"), "risk_score", "classification", "decision", pick(["MALICIOUS", "SUSPICIOUS", "TRUSTED", "UNKNOWN"], 4).alias("ti_verdict"),
        categories.alias("ti_categories"), (F.col("value") / 10).alias("analysis_time_ms"), F.when(dns, "dns").otherwise("analysis").alias("event_type"),
        F.when(dns, pick(["A", "AAAA", "TXT", "MX"], 4)).alias("query_type"),
        F.when(dns & (F.col("user_id") % 10 != 0), F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))).alias("client_address"),
        blocked.alias("blocked"), upstream.alias("upstream_used"), (served & (F.col("k") % 3 == 0)).alias("cache_hit"),
        F.when(dns, F.when(F.col("source_type") == "error", "NXDOMAIN").otherwise("NOERROR")).alias("response_code"),
        F.when(upstream, F.col("value") / 5).otherwise(0.0).alias("dns_upstream_time_ms"), F.when(dns, F.col("value") / 4).alias("total_gateway_time_ms"),
        F.when(F.col("k") % 4 == 3, F.array().cast(FACTORS)).otherwise(F.array(F.struct(pick(["DGA_HIGH", "SUSPICIOUS_TLD", "UNHEARD_OF"], 3).alias("code"), F.lit("medium").alias("severity"), (F.col("value") / 2).alias("contribution")))).alias("top_factors"),
        F.when(blocked, F.when(F.col("user_id") % 2 == 0, "NXDOMAIN").otherwise("REFUSED")).alias("block_policy"),
    )


DNS_EVENTS_SQL = """
    e as (
        select event_id as id, ts, user_id, event_type as source_type, value, json_extract_string(props, '$.k')::int as k,
            least(100, floor(value)::int) as risk_score, event_type <> 'signup' as is_dns
        from events
    ), f as (
        select *, case when risk_score < 30 then 'SAFE' when risk_score < 70 then 'SUSPICIOUS' else 'MALICIOUS' end as classification,
            case when risk_score < 30 then 'ALLOW' when risk_score < 70 then 'MONITOR' else 'BLOCK' end as decision,
            'd' || (user_id % 25)::varchar || '.test' as registrable_domain
        from e
    ), v_dns as (
        select id, ts, 'h' || (k % 12)::varchar || '.' || registrable_domain as domain, registrable_domain, risk_score, classification, decision,
            (['MALICIOUS', 'SUSPICIOUS', 'TRUSTED', 'UNKNOWN'])[k % 4 + 1] as ti_verdict,
            case k % 3 when 0 then ['malware', 'phishing'] when 1 then ['allowlisted', 'spam'] else [] end as ti_categories,
            value / 10 as analysis_time_ms, case when is_dns then 'dns' else 'analysis' end as event_type,
            case when is_dns then (['A', 'AAAA', 'TXT', 'MX'])[k % 4 + 1] end as query_type,
            case when is_dns and user_id % 10 <> 0 then '10.0.0.' || user_id::varchar end as client_address,
            decision = 'BLOCK' and is_dns as blocked, is_dns and decision <> 'BLOCK' and k % 3 <> 0 as upstream_used,
            is_dns and decision <> 'BLOCK' and k % 3 = 0 as cache_hit,
            case when is_dns then case when source_type = 'error' then 'NXDOMAIN' else 'NOERROR' end end as response_code,
            case when is_dns and decision <> 'BLOCK' and k % 3 <> 0 then value / 5 else 0 end as dns_upstream_time_ms,
            case when is_dns then value / 4 end as total_gateway_time_ms,
            case when k % 4 = 3 then [] else [{'code': (['DGA_HIGH', 'SUSPICIOUS_TLD', 'UNHEARD_OF'])[k % 3 + 1], 'severity': 'medium', 'contribution': value / 2}] end as top_factors,
            case when decision = 'BLOCK' and is_dns then case when user_id % 2 = 0 then 'NXDOMAIN' else 'REFUSED' end end as block_policy
        from f
    )
"""


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct hosts of the pages' urls, and how many pages each has."""
    host = F.lower(F.regexp_extract("url", r"^.*?://([^/?#]*)", 1))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(host.alias("raw")).where("raw <> ''").groupBy("raw").agg(F.count(F.lit(1)).alias("pages"))


PAGE_HOSTS_SQL = """
    hosts as (
        select lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)) as raw, count(*) as pages from pages
        where lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)) <> '' group by 1
    )
"""

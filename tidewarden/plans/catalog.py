"""Queries over the test tables, and the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden import dims
from tidewarden.functions import text as T
from tidewarden.operators import history, intel, scorers, training
from tidewarden.plans import analysis, captures_catalog, dashboards, feeds_catalog, lists_catalog, models_catalog, names_catalog, streams_catalog
from tidewarden.plans.views import DNS_EVENTS_SQL, PAGE_HOSTS_SQL, dns_events, page_hosts

#: The test events are sparse, so history looks back a day.
DAY = 1440


def _now(events: DataFrame):
    return events.agg(F.max("ts")).first()[0]


def _over(f):
    return lambda spark, sf_dir: f(dns_events(spark, sf_dir))


def _percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dns_events(spark, sf_dir)
    rows = [
        ("p95_analysis", dashboards.floor_percentile(e, "analysis_time_ms", 0.95)),
        ("p95_gateway", dashboards.floor_percentile(e, "total_gateway_time_ms", 0.95)),
        ("p99_gateway", dashboards.floor_percentile(e, "total_gateway_time_ms", 0.99)),
    ]
    return spark.createDataFrame(rows, "measure string, ms double").withColumn("ms", F.round("ms", 6))


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_hosts(spark, sf_dir)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = analysis.features(_hosts(spark, sf_dir))
    r = lambda c: F.round(c, 6)
    return f.select(
        "raw", "name.public_suffix", "name.registrable_domain", "name.sld", "name.subdomain", "cls.kind", F.size("name.labels").alias("labels"), r("feat.entropy").alias("entropy"),
        r("feat.digit_ratio").alias("digit_ratio"), r("feat.vowel_ratio").alias("vowel_ratio"), "feat.digit_run", "feat.max_label_length",
    )


def _intel(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = analysis.features(_hosts(spark, sf_dir)).select("name.domain", "name.registrable_domain")
    known = intel.candidates(dims.indicators(spark), dims.trusted(spark))
    out = intel.lookup(named, known)
    return out.select("domain", "intel.verdict", "intel.indicator", "intel.match_type", F.round("intel.confidence", 6).alias("confidence"))


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.lower("p_name").alias("p_name"))
    near = F.levenshtein("p_name", F.lit("almond antique"), 8)
    return part.select("p_partkey", F.size(T.minimal_matches(F.col("p_name"), ["an", "antique", "red", "green", "blue", "al"])).alias("matches"), F.when(near >= 0, near).alias("edits"))


def _bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.pair_counts(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name")


def _log_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training.log_probabilities(_bigrams(spark, sf_dir))
    return out.select("prev", "next", F.round("log_prob", 6).alias("log_prob"))


def _behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.trailing(dns_events(spark, sf_dir), DAY).withColumn("blocked", F.col("blocked_before"))
    out = scorers.behavioral(rows)
    return out.select("id", "total", "distinct_names", "max_risk", "blocked_before", "nxdomain", "behavioral.score", F.round("behavioral.confidence", 6).alias("confidence"), "behavioral.verdict")


def _client_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dns_events(spark, sf_dir)
    return history.client_behaviour(e, _now(e), 30 * DAY)


def _hourly(column: str, values: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = dns_events(spark, sf_dir)
        return dashboards.hourly(e if column == "classification" else e.where("event_type = 'dns'"), column, values, _now(e))

    return run


def _history_query(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = dns_events(spark, sf_dir)
        return f(e, _now(e))

    return run


def queries() -> dict:
    classes, decisions = ["SAFE", "SUSPICIOUS", "MALICIOUS"], ["ALLOW", "MONITOR", "BLOCK"]
    return {
        "events_page": _over(lambda e: dashboards.list_events(e, 50, 10, classification="malicious", query="H1%.D", event_type="DNS").select("id", "domain", "risk_score", "decision")),
        "events_total": _over(lambda e: dashboards.filtered(e, decision="monitor", query="d2").agg(F.count(F.lit(1)).alias("n"))),
        "by_classification": _over(lambda e: dashboards.counted(e, "classification", classes)),
        "by_decision": _over(lambda e: dashboards.counted(e.where(dashboards.is_dns()), "decision", decisions)),
        "by_verdict": _over(lambda e: dashboards.counted(e, "ti_verdict")),
        "by_query_type": _over(lambda e: dashboards.counted(e, "query_type")),
        "by_response_code": _over(lambda e: dashboards.counted(e, "response_code")),
        "timing_summary": _over(dashboards.timing),
        "timing_percentiles": _percentiles,
        "risk_histogram": _over(dashboards.risk_histogram),
        "top_risky_domains": _over(dashboards.top_risky),
        "top_blocked_domains": _over(dashboards.top_blocked),
        "threat_categories": _over(dashboards.categories),
        "activity_by_class": _hourly("classification", classes),
        "activity_by_decision": _hourly("decision", decisions),
        "source_stats": _over(dashboards.source_stats),
        "event_totals": _over(dashboards.totals),
        "log_lines": _over(dashboards.log_lines),
        "domain_history": _history_query(lambda e, now: history.domain_histories(e, now, DAY)),
        "client_history": _history_query(lambda e, now: history.client_histories(e, now, DAY)),
        "history_pair": _history_query(lambda e, now: history.history_pair(e, "10.0.0.7", now, 30 * DAY)),
        "trailing_behaviour": _behaviour,
        "client_behaviour": _client_behaviour,
        "host_features": _features,
        "intel_lookup": _intel,
        "keyword_matches": _keywords,
        "bigram_counts": _bigrams,
        "bigram_log_probs": _log_probs,
    } | names_catalog.queries() | feeds_catalog.queries() | lists_catalog.queries() | captures_catalog.queries() | streams_catalog.queries() | models_catalog.queries()


def _dns(select: str) -> str:
    return f"with {DNS_EVENTS_SQL} {select}"


def _pages(ctes: str, select: str) -> str:
    return f"with {PAGE_HOSTS_SQL} {',' if ctes else ''} {ctes} {select}"


def _measures(prefix: str = "", scope: str = "true") -> str:
    return f"""count(*) filter (where {scope} and event_type = 'dns') + count(distinct domain) filter (where {scope} and event_type <> 'dns') as {prefix}total,
        count(distinct domain) filter (where {scope}) as {prefix}distinct_names, coalesce(max(risk_score) filter (where {scope}), 0) as {prefix}max_risk,
        count(*) filter (where {scope} and blocked) as {prefix}blocked, count(*) filter (where {scope} and response_code = 'NXDOMAIN' and not blocked) as {prefix}nxdomain"""


def _since(minutes: int) -> str:
    return f"ts >= date_trunc('second', (select max(ts) from v_dns)) - interval {minutes} minute"


def _counted(column: str, keys: list[str] | None = None, where: str = "true") -> str:
    if not keys:
        return _dns(f"select {column}, count(*) as n from v_dns where {column} is not null and {where} group by 1")
    every = ", ".join(f"('{k}')" for k in keys)
    return _dns(f"select k.{column}, count(v.id) as n from (values {every}) k({column}) left join (select * from v_dns where {where}) v using ({column}) group by 1")


def _activity(column: str, values: list[str], where: str = "true") -> str:
    cells = ", ".join(f"count(*) filter (where {column} = '{v}') as \"{v}\"" for v in values)
    return _dns(f"select strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') as hour, {cells} from v_dns where {_since(DAY)} and {where} group by 1")


_BEHAVIOUR = """
    case when total < 3 then 0 else case when total >= 20 then 26 else 0 end + case when distinct_names >= 8 then 30 else 0 end
        + case when total >= 5 and nxdomain / total >= 0.5 then 22 else 0 end + case when {blocked} >= 3 then 20 else 0 end end::double as score
"""
_LISTED = ", ".join(f"'{s}'" for s in sorted(dims.REGISTRY_SUFFIXES + dims.PROVIDER_SUFFIXES) if "." in s)
_LOCAL = ", ".join(f"'{s}'" for s in dims.LOCAL_SUFFIXES)
_SPLIT = f"""
    l as (select raw, string_split(raw, '.') as labels from hosts),
    s as (
        select *, case when len(labels) >= 3 and array_to_string(labels[-3:], '.') in ({_LISTED}) then 3 when len(labels) >= 2 and array_to_string(labels[-2:], '.') in ({_LISTED}) then 2 else 1 end as depth from l
    ),
    named as (
        select *, array_to_string(labels[-depth:], '.') as public_suffix, case when len(labels) > depth then len(labels) - depth else 1 end as own, replace(raw, '.', '') as flat from s
    )
"""
_REGISTRABLE = "case when len(labels) = 1 then raw else array_to_string(labels[own:], '.') end"
_KNOWN = ", ".join([f"('{i}', '{v}', {c}::double, 0)" for i, v, _, c in dims.INDICATORS] + [f"('{d}', 'TRUSTED', 0.9::double, 1)" for d in dims.TRUSTED])

ORACLE_SQL = {
    "events_page": _dns("select id, domain, risk_score, decision from v_dns where event_type = 'dns' and classification = 'MALICIOUS' and domain ilike '%h1%.d%' order by id desc limit 50 offset 10"),
    "events_total": _dns("select count(*) as n from v_dns where decision = 'MONITOR' and domain ilike '%d2%'"),
    "by_classification": _counted("classification", ["SAFE", "SUSPICIOUS", "MALICIOUS"]),
    "by_decision": _counted("decision", ["ALLOW", "MONITOR", "BLOCK"], "event_type = 'dns'"),
    "by_verdict": _counted("ti_verdict"),
    "by_query_type": _counted("query_type"),
    "by_response_code": _counted("response_code"),
    "timing_summary": _dns("select round(avg(analysis_time_ms), 3) as mean_ms, round(min(analysis_time_ms), 3) as fastest_ms, round(max(analysis_time_ms), 3) as slowest_ms from v_dns"),
    "timing_percentiles": _dns("""
        , a as (select list_sort(list(analysis_time_ms)) as x from v_dns), g as (select list_sort(list(total_gateway_time_ms)) as x from v_dns where total_gateway_time_ms is not null)
        select 'p95_analysis' as measure, round(x[floor(len(x) * 0.95)::int + 1], 6) as ms from a
        union all select 'p95_gateway', round(x[floor(len(x) * 0.95)::int + 1], 6) from g union all select 'p99_gateway', round(x[floor(len(x) * 0.99)::int + 1], 6) from g"""),
    "risk_histogram": _dns("select r.bucket, count(v.id) as n from range(10) r(bucket) left join v_dns v on least(risk_score // 10, 9) = r.bucket group by 1"),
    "top_risky_domains": _dns("select domain, max(risk_score) as risk_score, arg_max(classification, (risk_score, id)) as classification, count(*) as hits from v_dns where risk_score >= 30 group by 1 order by 2 desc, 4 desc, 1 limit 10"),
    "top_blocked_domains": _dns("""select domain, max(risk_score) as risk_score, arg_max(query_type, (risk_score, id)) as query_type, count(*) as hits, arg_max(block_policy, (risk_score, id)) as policy,
        arg_max(case when len(top_factors) = 0 then 'no dominant factor' else case top_factors[1].code when 'DGA_HIGH' then 'looks generated' when 'SUSPICIOUS_TLD' then 'suffix with much abuse' else top_factors[1].code end end, (risk_score, id)) as reason
        from v_dns where event_type = 'dns' and blocked group by 1 order by 4 desc, 2 desc, 1 limit 15"""),
    "threat_categories": _dns(", c as (select unnest(ti_categories) as category from v_dns) select category, count(*) as n from c where category <> 'allowlisted' group by 1"),
    "activity_by_class": _activity("classification", ["SAFE", "SUSPICIOUS", "MALICIOUS"]),
    "activity_by_decision": _activity("decision", ["ALLOW", "MONITOR", "BLOCK"], "event_type = 'dns'"),
    "source_stats": _dns("""select client_address, count(*) as queries, count(distinct domain) as domains, count(*) filter (where blocked) as blocked, count(*) filter (where decision = 'MONITOR') as monitored,
        max(risk_score) as max_risk, max(ts) as last_seen, round(100 * count(*) filter (where blocked) / count(*), 1) as threat_rate
        from v_dns where client_address is not null group by 1 order by 4 desc, 2 desc, 1 limit 50"""),
    "event_totals": _dns("""select count(*) as events, count(*) filter (where event_type = 'dns') as dns_events, count(*) filter (where classification <> 'SAFE') as threats, count(*) filter (where cache_hit) as cache_hits,
        count(*) filter (where event_type = 'dns' and client_address is null) as unattributed, count(total_gateway_time_ms) as measured_queries,
        round(coalesce(avg(dns_upstream_time_ms) filter (where upstream_used and not cache_hit), 0), 3) as mean_upstream_ms, round(avg(total_gateway_time_ms), 3) as mean_gateway_ms, round(max(total_gateway_time_ms), 3) as slowest_gateway_ms from v_dns"""),
    "log_lines": _dns("""select id, ts, domain, case when decision = 'BLOCK' then 'BLOCKED' when response_code = 'SERVFAIL' then 'ERROR' when decision = 'MONITOR' then 'WARNING' else 'INFO' end as severity,
        case when blocked then 'blocked' when cache_hit then 'answered from cache' when upstream_used then 'resolved upstream' else 'analysed' end as action,
        coalesce(client_address, case when event_type = 'dns' then 'unattributed' else 'analysis' end) as source from v_dns"""),
    "domain_history": _dns(f"select registrable_domain, {_measures()} from v_dns where {_since(DAY)} group by 1"),
    "client_history": _dns(f"select client_address, registrable_domain, {_measures()} from v_dns where {_since(DAY)} and client_address is not null and event_type = 'dns' group by 1, 2"),
    "history_pair": _dns(f"select registrable_domain, {_measures()}, {_measures('client_', "coalesce(client_address = '10.0.0.7' and event_type = 'dns', false)")} from v_dns where {_since(30 * DAY)} group by 1"),
    "trailing_behaviour": _dns(f"""
        , w as (
            select id, count(*) filter (where event_type = 'dns') over past + count(distinct case when event_type <> 'dns' then domain end) over past as total, count(distinct domain) over past as distinct_names,
                coalesce(max(risk_score) over past, 0) as max_risk, count(*) filter (where blocked) over past as blocked_before, count(*) filter (where response_code = 'NXDOMAIN' and not blocked) over past as nxdomain
            from v_dns window past as (partition by registrable_domain order by epoch_us(ts) range between {DAY * 60_000_000} preceding and 1 preceding)
        ), b as (select *, {_BEHAVIOUR.format(blocked='blocked_before')} from w)
        select *, round((case when score > 0 then least(0.85, 0.5 + 0.01 * total) else 0 end)::double, 6) as confidence,
            case when total < 3 then 'INSUFFICIENT_HISTORY' when score > 0 then 'ANOMALOUS' else 'NORMAL' end as verdict from b"""),
    "client_behaviour": _dns(f"""
        , h as (select client_address, registrable_domain, {_measures()} from v_dns where {_since(30 * DAY)} and client_address is not null and event_type = 'dns' group by 1, 2),
        b as (select *, {_BEHAVIOUR.format(blocked='blocked')} from h),
        r as (select *, row_number() over (partition by client_address order by score desc, registrable_domain) as nth, max(score) over (partition by client_address) as most, max(total) over (partition by client_address) as longest from b)
        select client_address, registrable_domain, score, total, case when most > 0 then 'ANOMALOUS' when longest >= 3 then 'NORMAL' else 'INSUFFICIENT_HISTORY' end as verdict from r where nth = 1"""),
    "host_features": _pages(_SPLIT, f"""
        select raw, public_suffix, {_REGISTRABLE} as registrable_domain, labels[own] as sld, array_to_string(labels[:own - 1], '.') as subdomain,
            case when len(labels) = 1 then case when raw in ({_LOCAL}) then 'LOCAL_NAME' else 'SINGLE_LABEL' end when labels[-1] in ({_LOCAL}) then 'LOCAL_NAME' else 'REGISTRY_DOMAIN' end as kind,
            len(labels)::int as labels,
            round((select -sum(p * log2(p)) from (select count(*) / length(flat) as p from (select unnest(string_split(flat, '')) as c) group by c)), 6) as entropy,
            round(length(regexp_replace(flat, '[^0-9]', '', 'g')) / length(flat), 6) as digit_ratio, round(length(regexp_replace(flat, '[^aeiou]', '', 'g')) / length(regexp_replace(flat, '[^a-z]', '', 'g')), 6) as vowel_ratio,
            coalesce(list_max(list_transform(regexp_extract_all(flat, '[0-9]+'), lambda x: length(x))), 0) as digit_run, list_max(list_transform(labels, lambda x: length(x))) as max_label_length
        from named"""),
    "intel_lookup": _pages(_SPLIT + f"""
        , d as (select raw as domain, {_REGISTRABLE} as registrable_domain, labels from named),
        c as (select domain, i - 1 as depth, array_to_string(labels[i:], '.') as indicator from d, range(1, 64) r(i) where i <= len(labels) - len(string_split(registrable_domain, '.')) + 1),
        k as (select * from (values {_KNOWN}) t(indicator, verdict, confidence, priority)),
        h as (select c.domain, c.depth, k.*, row_number() over (partition by domain order by depth, priority) as nth from c join k using (indicator))""", """
        select d.domain, coalesce(verdict, 'UNKNOWN') as verdict, indicator, case when depth > 0 then 'PARENT_DOMAIN' when depth = 0 then 'EXACT' end as match_type,
            round(case when verdict is null then 0 when verdict = 'TRUSTED' then case when depth > 0 then 0.85 else 0.9 end when depth > 0 then round(confidence * 0.9, 3) else confidence end, 6) as confidence
        from d left join (select * from h where nth = 1) h using (domain)"""),
    "keyword_matches": """
        with p as (select p_partkey, lower(p_name) as p_name from part), m as (select *, list_filter(['an', 'antique', 'red', 'green', 'blue', 'al'], lambda w: contains(p_name, w)) as found from p)
        select p_partkey, len(list_filter(found, lambda w: len(list_filter(found, lambda o: o <> w and contains(o, w))) = 0))::int as matches,
            case when levenshtein(p_name, 'almond antique') <= 8 then levenshtein(p_name, 'almond antique') end::int as edits from m""",
    "bigram_counts": """
        with m as (select '^' || regexp_replace(lower(p_name), '[^a-z0-9-]', '', 'g') || '$' as s from part), p as (select substr(s, i, 2) as p from m, range(1, 256) r(i) where length(s) > 2 and i < length(s))
        select p[1] as prev, p[2] as next, count(*) as n from p group by 1, 2""",
}
ORACLE_SQL["bigram_log_probs"] = f"""
    with counts as ({ORACLE_SQL["bigram_counts"]}), grid as (
        select a.c as prev, b.c as next from (select unnest(string_split('^{training.ALPHABET}', '')) as c) a, (select unnest(string_split('{training.ALPHABET}$', '')) as c) b
    ), totals as (select prev, sum(n) as total from counts group by 1)
    select g.prev, g.next, round(ln((coalesce(n, 0) + 0.1) / (coalesce(total, 0) + 0.1 * 38)), 6) as log_prob from grid g left join counts c on g.prev = c.prev and g.next = c.next left join totals t on g.prev = t.prev
"""
ORACLE_SQL |= names_catalog.ORACLE_SQL | feeds_catalog.ORACLE_SQL | lists_catalog.ORACLE_SQL | captures_catalog.ORACLE_SQL | streams_catalog.ORACLE_SQL | models_catalog.ORACLE_SQL
# What a stream keeps equals what the table gives.
ORACLE_SQL |= {"kept_top_risky": ORACLE_SQL["top_risky_domains"], "kept_top_blocked": ORACLE_SQL["top_blocked_domains"], "kept_sources": ORACLE_SQL["source_stats"], "kept_activity": ORACLE_SQL["stream_hourly"].replace("from v_dns group by", "from v_dns where event_type = 'dns' group by")}

"""Queries over the readers, the store, the gateway, streams and captures, and their SQL.

Logs and captures are made from the event table, written or put together as bytes, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden import dims
from tidewarden.functions import registry
from tidewarden.functions.names import LABEL_SPAN, canonicalize
from tidewarden.operators import replay, scorers, training
from tidewarden.plans import analysis, dashboards
from tidewarden.plans import names_catalog as names
from tidewarden.plans.views import DNS_EVENTS_SQL, as_dns, dns_events
from tidewarden.shared import shared_folder
from tidewarden.sources import captures, event_store, zeek
from tidewarden.streaming import live, verdicts

#: Raw input around the borders of what a name may be.
RAW = [
    ' "Shop.Example.NET." ', "https://me@News.example.org:8443/a?b=c", "<cdn.example.com>", "", "   ", None, "x" * 2048, "x" * 2049, "b" * 63 + ".example.com", "b" * 64 + ".example.com",
    ".".join(["c" * 49] * 5) + ".com", ".".join(["c" * 49] * 5) + ".come", "a..b.example", "two words.example", "under_score.example.com", "example.77", "http:///nothing", "ftp://", "tail-.example.com",
    "127.0.0.1", "someone@mail.example.com", "host.example.com:53", "EXAMPLE.com/", "dots.example.com...",
]
#: What the capture of names asks for: names of every kind, and some that are none.
ASKED = [*names.NAMES, "two..dots.example", "bad-.example.com"]
#: Microseconds since 1970 of times without a zone.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
TYPE_CODES = {"A": 1, "AAAA": 28, "TXT": 16, "MX": 15}


def _name_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(RAW)), "i int, raw string")
    return canonicalize(rows).select("i", "name.domain", "name.error_code", "name.was_url")


def _capture(table: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = dns_events(spark, sf_dir).where("event_type = 'dns'")
        asked = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("id") % len(ASKED) + 1).cast("int"))
        both = F.explode(F.array(F.lit(False), F.lit(True)))  # a question and its response
        out = analysis.capture_report(e.select(asked.alias("domain"), "query_type", F.col("client_address").alias("source_ip"), both.alias("is_response"), F.col("id").alias("seq")))[table]
        return out.withColumn("tunnel_indicators", F.array_join("tunnel_indicators", ",")) if "tunnel_indicators" in out.columns else out

    return run


def _gateway(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dns_events(spark, sf_dir).where("event_type = 'dns'")
    n = F.col("id")
    invalid = F.when(n % 29 == 0, "EMPTY_LABEL")
    upstream = F.when(n % 13 != 0, F.col("response_code"))
    out = dashboards.gateway_outcome(F.col("decision"), n % 50 != 0, n % 41 != 0, n % 37 != 0, invalid, F.col("cache_hit"), upstream, "REFUSED")
    address = F.when(n % 3 == 0, "127.0.0.1").otherwise(F.col("client_address"))
    return e.select("id", out.alias("o"), dashboards.loopback_only(address, "loopback_only").alias("stored_address")).select("id", "o.*", "stored_address")


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dns_events(spark, sf_dir)
    codes = F.element_at(F.array(*(F.array(F.lit(c)) for c in ("DNS_TUNNEL_INDICATORS", "BEHAVIORAL_ANOMALY", "DGA_HIGH", "BRAND_IMPERSONATION", "LENGTH_LONG"))), (F.col("id") % 5 + 1).cast("int"))
    return e.where("decision <> 'ALLOW'").groupBy(dashboards.reason(F.col("ti_verdict"), codes).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "events")
    e = dns_events(spark, sf_dir)
    event_store.append(e.where("event_type = 'dns'"), path, 0)
    event_store.append(e.where("event_type <> 'dns'"), path, 1)
    event_store.append(e.where("event_type <> 'dns'"), path, 1)  # again: in place of the batch
    out = event_store.read(spark, path)
    kept = out.agg(F.count_distinct("id")).first()[0]
    return out.groupBy("event_type", "decision", "blocked", "response_code").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("risk"), F.sum(F.size("ti_categories")).alias("categories")).withColumn("ids", F.lit(kept).cast("long"))


def zeek_log(e: DataFrame, path: str) -> None:
    """Writes the events as four logs; rows whose ``domain`` is null have no query."""
    spark = e.sparkSession
    fields = {
        "ts": F.format_string("%.6f", F.expr(MICROS) / 1e6), "id.orig_h": F.coalesce("client_address", F.lit("-")), "id.resp_h": F.lit("192.0.2.53"),
        "query": F.coalesce(F.concat("domain", F.lit(".")), F.lit("-")), "qtype_name": F.when(F.col("query_type") == "A", "-").otherwise(F.col("query_type")), "rcode_name": F.col("response_code"),
    }
    header = "\n".join(["#separator \\x09", "#unset_field\t-", "#path\tdns", "#fields\t" + "\t".join(fields)])
    logs = spark.range(4).select(F.col("id").alias("log"), F.lit(0).alias("row"), F.lit(header).alias("value"))
    rows = e.select((F.col("id") % 4).alias("log"), F.lit(1).alias("row"), F.concat_ws("\t", *fields.values()).alias("value"))
    logs.unionByName(rows).repartition(4, "log").sortWithinPartitions("log", "row").select("value").write.text(path)


def _zeek(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "zeek")
    zeek_log(dns_events(spark, sf_dir).where("event_type = 'dns'").withColumn("domain", F.when(F.col("id") % 10 > 0, F.col("domain"))), path)
    return zeek.read_zeek(spark, path).select("domain", "query_type", "source_ip", "dest_ip", F.round("timestamp", 3).alias("timestamp"), "is_response", "rcode")


def _hex(x, size: int):
    return F.lpad(F.hex(x), 2 * size, "0")


def _little(x):
    h = _hex(x, 4)
    return F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1)))


def capture_files(events: DataFrame) -> DataFrame:
    """Rows (path, length, content): one libpcap capture of raw IP packets for each day of the events."""
    labels = F.transform(F.split("domain", r"\."), lambda x: F.concat(_hex(F.length(x), 1), F.hex(x)))
    types = F.create_map(*(F.lit(x) for kv in TYPE_CODES.items() for x in kv))
    message = F.concat(F.lit("1234"), F.when(F.col("id") % 2 == 0, "8180").otherwise("0100"), F.lit("0001000000000000"), F.array_join(labels, ""), F.lit("00"), _hex(F.element_at(types, F.col("query_type")), 2), F.lit("0001"))
    address = F.array_join(F.transform(F.split(F.coalesce("client_address", F.lit("10.1.1.1")), r"\."), lambda x: _hex(x.cast("int"), 1)), "")
    df = events.withColumn("message", message)
    size = F.length("message") / 2
    packet = F.concat(F.lit("4500"), _hex((size + 28).cast("int"), 2), F.lit("0000000040110000"), address, F.lit("C0000235"), F.lit("C0000035"), _hex((size + 8).cast("int"), 2), F.lit("0000"), "message")
    df = df.withColumn("packet", packet)
    us, n = F.expr(MICROS), (F.length("packet") / 2).cast("int")
    record = F.concat(_little(F.floor(us / 1_000_000)), _little(us % 1_000_000), _little(n), _little(n), "packet")
    days = df.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("path")).agg(F.array_sort(F.collect_list(F.struct("id", record.alias("r")))).alias("records"))  # a day's packets are a file
    content = F.unhex(F.concat(F.lit("D4C3B2A1020004000000000000000000FFFF000065000000"), F.array_join(F.transform("records", lambda x: x["r"]), "")))
    return days.select("path", content.alias("content")).withColumn("length", F.length("content"))


def _pcap(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = capture_files(dns_events(spark, sf_dir).where("event_type = 'dns'"))
    none = spark.createDataFrame([("short", 3, b"abc"), ("other", 30, b"x" * 30)], "path string, length int, content binary")
    return captures.decoded(files.unionByName(none)).withColumn("timestamp", F.round("timestamp", 3))


def _stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    arriving, stored = shared_folder(spark, "arriving"), spark.read.parquet(f"{sf_dir}/events.parquet")
    stored.repartition(4).write.parquet(arriving)
    events = as_dns(live.event_stream(spark, arriving, stored.schema, files=1)).withColumn("ts", F.col("ts").cast("timestamp"))
    path, values = shared_folder(spark, "hourly"), ["ALLOW", "MONITOR", "BLOCK"]
    hours = live.hourly_activity(events, "decision", values)
    query = hours.writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path)


def _separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    out = training.separation(part.select(F.col("p_size").cast("string").alias("family"), ((F.col("p_partkey") * 37) % 1000 / 1000).alias("score")))
    return out.select("family", *(F.round(c, 6).alias(c) for c in ("mean", "median", "share")))


def _sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry.register(spark)
    names.hosts(spark, sf_dir).createOrReplaceTempView("asked_names")
    return spark.sql("select raw, round(entropy(replace(raw, '.', '')), 6) as entropy, registrable_domain(raw) as registrable, classify_name(raw) as kind, s.depth, s.suffix from asked_names, lateral dns_suffixes(raw) s")


DAY = 24 * 60


def evidence(events: DataFrame) -> DataFrame:
    """Events whose shape gives the score; what history adds decides the rest."""
    signal = F.struct(F.lit("lexical").alias("name"), F.col("risk_score").cast("double").alias("score"), F.lit(0.85).alias("confidence"), F.lit(LABEL_SPAN).alias("scope_key"), F.lit("SCORED").alias("verdict"), F.array().alias("factors"))
    return events.withColumn("lexical", signal.cast(scorers.SIGNAL))


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replay.replay(evidence(dns_events(spark, sf_dir)), DAY)
    return out.select("id", F.round("behavioral_score", 6).alias("behavioral_score"), F.round("raw_score", 6).alias("raw_score"), "risk_score", "decision", "blocked")


def _stream_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same verdicts from a stream: files in order of time, one a micro-batch, and a state for each domain."""
    path, name = shared_folder(spark, "verdicts"), "spark.sql.streaming.stateStore.providerClass"
    stored = spark.read.parquet(f"{sf_dir}/events.parquet")
    stored.repartitionByRange(3, "ts", "event_id").write.parquet(f"{path}/arriving")
    for f in range(3):  # files arrive in order of their names
        spark.read.schema(stored.schema).parquet(f"{path}/arriving/part-{f:05d}*").coalesce(1).write.mode("append").parquet(f"{path}/in")
    events = as_dns(live.event_stream(spark, f"{path}/in", stored.schema, files=1)).withColumn("ts", F.col("ts").cast("timestamp"))
    before = spark.conf.get(name)
    spark.conf.set(name, verdicts.PROVIDER)
    try:
        verdicts.judge_into(evidence(events), f"{path}/out", f"{path}/checkpoint", DAY, watermark="0 seconds", availableNow=True).awaitTermination()
    finally:
        spark.conf.set(name, before)
    out = spark.read.parquet(f"{path}/out")
    return out.select("id", F.round("behavioral_score", 6).alias("behavioral_score"), F.round("raw_score", 6).alias("raw_score"), "risk_score", "decision", "blocked")


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.generated_names(spark, 200, dims.WORDS)


def _family_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the generated-name score tells each family from chance."""
    named = analysis.features(_families(spark, sf_dir).withColumn("raw", F.concat("name", F.lit(".com"))))
    scored = scorers.dga(named, analysis.default_model(spark)).select("family", F.col("dga_score").alias("score"))
    return training.separation(scored).select("family", *(F.round(c, 6).alias(c) for c in ("mean", "median", "share")))


def queries() -> dict:
    return {
        "name_errors": _name_errors, **{f"capture_{t}": _capture(t) for t in ("findings", "sources", "types", "totals", "rejected")}, "gateway_outcomes": _gateway, "block_reasons": _reasons,
        "decision_shares": lambda spark, sf_dir: dashboards.shares(dns_events(spark, sf_dir), "decision"), "stored_events": _stored, "zeek_queries": _zeek, "pcap_questions": _pcap, "stream_hourly": _stream_hourly,
        "family_separation": _separation, "sql_functions": _sql_functions, "replayed_verdicts": _replayed, "stream_verdicts": _stream_verdicts, "generated_names": _families, "family_scores": _family_scores,
    }


def _dns(select: str) -> str:
    return f"with {DNS_EVENTS_SQL}, d as (select * from v_dns where event_type = 'dns') {select}"


def _raw(x: str | None) -> str:
    return "null::varchar" if x is None else f"repeat('x', {len(x)})" if set(x) == {"x"} else "'" + x.replace("'", "''") + "'"


_ASSESSED = names.ORACLE_SQL["assessed_hosts"].removeprefix("with recursive ")
_VERDICTS = f"""with recursive {DNS_EVENTS_SQL}, {_ASSESSED.split("select raw, score, round(")[0]},
    asked as (select id as seq, ({names._list(ASKED)})[id % {len(ASKED)} + 1] as key, query_type, client_address from v_dns where event_type = 'dns'),
    first as (select key, min(seq) as seq from asked group by 1),
    verdicts as (
        select f.key, f.seq, x.score, x.classification, x.decision, x.verdict, round(x.dga_score, 1) as dga_score, round(x.tunnel_score, 1) as tunnel_score, u.indicators, g.dga_codes, s.registrable, s.kind
        from first f join decided x on f.key = x.raw join tunnel u on u.raw = x.raw join dga g on g.raw = x.raw join spans s on s.raw = x.raw
    )"""
_BACK = "left join verdicts v on a.key = v.key"


def _drawn(family: str, part: str) -> str:
    return f"('0x' || substr(md5('0:{family}:' || i || ':' || {part}), 1, 8))::bigint"


_FAMILY = " union all ".join(
    f"select '{f}' as family, i, array_to_string(list_transform(range(1, {_drawn(f, repr('n'))} % {most - least + 1} + {least + 1}), lambda p: substr('{x}', {_drawn(f, 'p')} % {len(x)} + 1, 1)), '') as name from r"
    for f, (x, least, most) in training.FAMILIES.items()
)
_PAIR = " || ".join(f"({names._list(dims.WORDS)})[{_drawn('word_pair', repr(p))} % {len(dims.WORDS)} + 1]" for p in "12")
#: One row of each domain a step, with the rows before it and their verdicts in a list.
_WALK = """with recursive {views}, q as (select *, row_number() over (partition by registrable_domain order by ts, id) as n from v_dns),
    walk as (
        select registrable_domain, 0::bigint as n, null::bigint as id, 0.0::double as bs, 0.0::double as raw, false as blocked, []::struct(ts timestamp, domain varchar, dns boolean, missing boolean, blocked boolean)[] as past
        from (select distinct registrable_domain from q)
        union all
        select registrable_domain, n, id, bs, raw, blocked, list_append(near, struct_pack(ts := ts, domain := domain, dns := dns, missing := missing, blocked := blocked)) from (
            select *, dns and round_even(raw, 0) >= 70 as blocked from (
                select *, greatest(0, least(100, (0.2125 * risk_score + 0.1 * conf * bs) / (0.2125 + 0.1 * conf) + case when risk_score >= 70 and bs >= 70 then 8 else 0 end)) as raw from (
                    select *, case when bs > 0 then least(0.85, 0.5 + 0.01 * total) else 0 end as conf from (
                        select *, case when total < 3 then 0 else least(100, case when total >= 20 then 26 else 0 end + case when uniq >= 8 then 30 else 0 end
                            + case when total >= 5 and nx / total >= 0.5 then 22 else 0 end + case when held >= 3 then 20 else 0 end) end::double as bs from (
                            select *, len(list_filter(seen, lambda x: x.dns)) + len(list_distinct(list_transform(list_filter(seen, lambda x: not x.dns), lambda x: x.domain))) as total,
                                len(list_distinct(list_transform(seen, lambda x: x.domain))) as uniq, len(list_filter(seen, lambda x: x.blocked)) as held, len(list_filter(seen, lambda x: x.missing and not x.blocked)) as nx from (
                                select *, list_filter(near, lambda x: x.ts < ts) as seen from (
                                    select q.registrable_domain, q.n, q.id, q.ts::timestamp as ts, q.domain, q.event_type = 'dns' as dns, coalesce(q.response_code = 'NXDOMAIN', false) as missing, q.risk_score,
                                        list_filter(w.past, lambda x: x.ts >= q.ts::timestamp - interval 1 day) as near
                                    from walk w join q on q.registrable_domain = w.registrable_domain and q.n = w.n + 1
                                )
                            )
                        )
                    )
                )
            )
        )
    )
    select id, round(bs, 6) as behavioral_score, round(raw, 6) as raw_score, round_even(raw, 0)::int as risk_score, case when round_even(raw, 0) < 30 then 'ALLOW' when round_even(raw, 0) < 70 then 'MONITOR' else 'BLOCK' end as decision, blocked
    from walk where n > 0"""
ORACLE_SQL = {
    "name_errors": rf"""
        with r as (select * from (values {", ".join(f"({i}, {_raw(x)})" for i, x in enumerate(RAW))}) t(i, raw)),
        a as (select *, trim(trim(trim(raw), '"''<>')) as t from r), b as (select *, contains(t, '://') as is_url, case when contains(t, '://') then regexp_extract(t, '(?s)^.*?://(.*)$', 1) else t end as rest from a),
        c as (select *, coalesce(is_url or regexp_matches(rest, '[/?#@]'), false) as was_url, regexp_replace(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '(?s)^.*@', '') as authority from b),
        d as (select *, coalesce(case when length(authority) - length(replace(authority, ':', '')) = 1 then split_part(authority, ':', 1) else authority end, '') as host from c),
        e as (select *, lower(regexp_replace(host, '\.+$', '')) as name, string_split(lower(regexp_replace(host, '\.+$', '')), '.') as labels from d),
        f as (select *, list_filter(list_transform(labels, lambda x: case when x = '' then 'EMPTY_LABEL' when length(x) > 63 then 'LABEL_TOO_LONG' when not regexp_matches(x, '^[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?$') then 'INVALID_LABEL_FORMAT' end), lambda x: x is not null) as wrong,
            regexp_matches(name, '^\d+\.\d+\.\d+\.\d+$') as is_ip from e),
        g as (select *, case when length(trim(coalesce(raw, ''))) = 0 then 'EMPTY_INPUT' when length(raw) > 2048 then 'INPUT_TOO_LARGE' when host = '' then case when was_url then 'INVALID_URL' else 'EMPTY_INPUT' end
            when is_ip then null when length(name) > 253 then 'DOMAIN_TOO_LONG' else coalesce(wrong[1], case when len(labels) > 1 and regexp_matches(labels[-1], '^\d+$') then 'NUMERIC_TLD' end) end as error_code from f)
        select i, case when error_code is null then name end as domain, error_code, was_url from g""",
    "capture_findings": f"""{_VERDICTS} select key, key as domain, registrable as registrable_domain, kind as name_kind, score, classification, decision, verdict, dga_score, dga_codes in ('DGA_HIGH', 'DGA_MODERATE') as is_generated,
        tunnel_score, indicators <> '' as is_tunnel, indicators as tunnel_indicators from verdicts order by score desc, key limit 100""",
    "capture_sources": f"""{_VERDICTS} select coalesce(client_address, 'unknown') as source_ip, count(*) as queries, count(distinct a.key) as domains, count(*) filter (where decision = 'BLOCK') as blocked,
        count(*) filter (where decision = 'MONITOR') as monitored, count(*) filter (where decision = 'ALLOW') as allowed, round(100 * count(*) filter (where decision = 'BLOCK') / count(*), 1) as threat_rate from asked a {_BACK} group by 1""",
    "capture_types": _dns("select query_type, count(*) as n from d group by 1"),
    "capture_totals": f"""{_VERDICTS} select (select count(*) from first) as names, (select count(*) from first) - count(*) as rejected, count(*) filter (where classification = 'MALICIOUS') as malicious,
        count(*) filter (where classification = 'SUSPICIOUS') as suspicious, count(*) filter (where classification = 'SAFE') as safe, count(*) filter (where decision = 'BLOCK') as blocked, count(*) filter (where decision = 'MONITOR') as monitored,
        count(*) filter (where dga_codes in ('DGA_HIGH', 'DGA_MODERATE')) as generated, count(*) filter (where indicators <> '') as tunnels, count(*) filter (where verdict in ('MALICIOUS', 'SUSPICIOUS')) as listed, (select count(*) from asked) as queries from verdicts""",
    "capture_rejected": "select * from (values ('two..dots.example', 'EMPTY_LABEL'), ('bad-.example.com', 'INVALID_LABEL_FORMAT')) t(key, error_code)",
    "gateway_outcomes": _dns("""
        , o as (select *, id % 50 <> 0 and id % 41 <> 0 as readable, id % 37 <> 0 as is_query, id % 29 = 0 as invalid, case when id % 13 <> 0 then response_code end as upstream from d)
        select id, case when not readable then 'FORMERR' when not is_query then 'NOTIMP' when invalid then 'REFUSED' when decision = 'BLOCK' then 'REFUSED' when cache_hit then 'NOERROR' else coalesce(upstream, 'SERVFAIL') end as rcode,
            readable and is_query and (invalid or decision = 'BLOCK') as blocked, readable and is_query and not invalid and cache_hit and decision <> 'BLOCK' as from_cache, readable and is_query and not invalid as logged,
            case when id % 3 = 0 then '127.0.0.1' end as stored_address from o"""),
    "block_reasons": _dns("""select case when ti_verdict = 'MALICIOUS' then 'listed as malicious' when id % 5 = 0 then 'possible tunnel' when id % 5 = 1 then 'odd behaviour' when id % 5 = 2 then 'generated name' when id % 5 = 3 then 'imitates a brand'
        when ti_verdict = 'SUSPICIOUS' then 'listed as suspicious' else 'score over the bar' end as reason, count(*) as n from v_dns where decision <> 'ALLOW' group by 1"""),
    "decision_shares": _dns("select decision, count(*) as n, round(100 * count(*) / (select count(*) from v_dns), 1) as share from v_dns group by 1"),
    "stored_events": _dns("select event_type, decision, blocked, response_code, count(*) as n, sum(risk_score)::bigint as risk, sum(len(ti_categories))::bigint as categories, (select count(*) from v_dns) as ids from v_dns group by 1, 2, 3, 4"),
    "zeek_queries": _dns("select domain, query_type, client_address as source_ip, '192.0.2.53' as dest_ip, round(epoch_us(ts) / 1e6, 3) as timestamp, false as is_response, response_code as rcode from d where id % 10 <> 0"),
    "pcap_questions": _dns("""select strftime(ts, '%Y-%m-%d') as path, row_number() over (partition by strftime(ts, '%Y-%m-%d') order by id) - 1 as seq, domain, query_type, coalesce(client_address, '10.1.1.1') as source_ip, '192.0.2.53' as dest_ip, 'udp' as transport,
        round(epoch_us(ts) / 1e6, 3) as timestamp, id % 2 = 0 as is_response, null as error from d union all select 'short', null, null, null, null, null, null, null, null, 'TOO_SHORT' union all select 'other', null, null, null, null, null, null, null, null, 'UNKNOWN_FORMAT'"""),
    "stream_hourly": _dns("select strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') as hour, count(*) filter (where decision = 'ALLOW') as \"ALLOW\", count(*) filter (where decision = 'MONITOR') as \"MONITOR\", count(*) filter (where decision = 'BLOCK') as \"BLOCK\" from v_dns group by 1"),
    "family_separation": """with s as (select p_size::varchar as family, (p_partkey * 37) % 1000 / 1000 as score from part)
        select family, round(avg(score), 6) as mean, round(list_sort(list(score))[count(*) // 2 + 1], 6) as median, round(avg((score >= 0.5)::int), 6) as share from s group by 1""",
    "sql_functions": f"""with {names.NAMES_SQL} select raw, round({names._entropy("flat")}, 6) as entropy, registrable, kind, (i - 1)::int as depth, array_to_string(labels[i:], '.') as suffix from spans, range(1, 64) r(i) where i <= len(labels)""",
    "replayed_verdicts": _WALK.replace("{views}", DNS_EVENTS_SQL),
    "stream_verdicts": _WALK.replace("{views}", DNS_EVENTS_SQL),
    "generated_names": f"with r as (select range as i from range(200)) {_FAMILY} union all select 'word_pair', i, {_PAIR} from r",
}

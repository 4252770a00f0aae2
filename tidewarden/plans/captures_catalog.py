"""Queries over captures that are read in ranges, their answers, and the report over all readers, with their SQL.

Captures are written from the event table first, by the package's own writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.plans import analysis
from tidewarden.plans.feeds_catalog import _VERDICTS, ASKED, MICROS, TYPE_CODES, zeek_log
from tidewarden.plans.views import DNS_EVENTS_SQL, dns_events
from tidewarden.shared import shared_folder
from tidewarden.sources import capture_source, common

#: Bytes of a range in these queries: small, so that small captures are many.
RANGE = 1 << 16


def _hex(x: Column, size: int) -> Column:
    return F.lpad(F.hex(x), 2 * size, "0")


def _record(kind: int, ttl: Column, data: Column) -> Column:
    """A record of the asked name, which its pointer leads to."""
    return F.concat(F.lit(f"C00C{kind:04X}0001"), _hex(ttl, 4), _hex((F.length(data) / 2).cast("int"), 2), data)


def packets(events: DataFrame) -> DataFrame:
    """Rows (timestamp, packet), raw IP: each event's question, and in every second one the answer: none to two answers, some
    with an authority and with a pseudo-record."""
    n = F.col("id")
    labels = F.transform(F.split("domain", r"\."), lambda x: F.concat(_hex(F.length(x), 1), F.hex(x)))
    types = F.create_map(*(F.lit(x) for kv in TYPE_CODES.items() for x in kv))
    replies = n % 2 == 0
    one, two = replies & (n % 3 > 0), replies & (n % 3 == 2)
    authority, extra = replies & (n % 4 == 0), replies & (n % 5 == 0)
    count = lambda *tests: _hex(sum((t.cast("int") for t in tests), F.lit(0)), 2)
    body = F.concat(
        F.when(one, _record(1, n * 7 % 400, F.concat(F.lit("0A"), _hex(n % 2**24, 3)))).otherwise(""), F.when(two, _record(5, n * 11 % 90, F.lit("0363646EC00C"))).otherwise(""),
        F.when(authority, _record(2, n * 13 % 50, F.lit("026E73C00C"))).otherwise(""), F.when(extra, F.lit("0000291000000080000000")).otherwise(""),
    )
    head = F.concat(F.lit("1234"), F.when(replies, "8180").otherwise("0100"), F.lit("0001"), count(one, two), count(authority), count(extra))
    message = F.concat(head, F.array_join(labels, ""), F.lit("00"), _hex(F.element_at(types, F.col("query_type")), 2), F.lit("0001"), body)
    address = F.array_join(F.transform(F.split(F.coalesce("client_address", F.lit("10.1.1.1")), r"\."), lambda x: _hex(x.cast("int"), 1)), "")
    size = (F.length("message") / 2).cast("int")
    packet = F.concat(F.lit("4500"), _hex(size + 28, 2), F.lit("0000000040110000"), address, F.lit("C0000235"), F.lit("C0000035"), _hex(size + 8, 2), F.lit("0000"), "message")
    df = events.withColumn("message", message)
    return df.select("id", (F.expr(MICROS) / 1e6).alias("timestamp"), F.unhex(packet).alias("packet"))


def written(spark: SparkSession, events: DataFrame) -> str:
    """The folder of the events' captures, one file for each partition."""
    path = shared_folder(spark, "captures")
    capture_source.write_packets(packets(events).repartitionByRange(4, "id").sortWithinPartitions("id"), path)
    return path


def _dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dns_events(spark, sf_dir).where("event_type = 'dns'")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = capture_source.read_questions(spark, written(spark, _dns(spark, sf_dir)), RANGE)
    return out.select("domain", "query_type", "source_ip", "dest_ip", "transport", F.round("timestamp", 3).alias("timestamp"), "is_response", "error")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = capture_source.read_records(spark, written(spark, _dns(spark, sf_dir)), RANGE)
    return out.select("section", "nth", "name", "record_type", "record_class", "ttl", "data", F.round("timestamp", 3).alias("timestamp"))


def _lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = written(spark, _dns(spark, sf_dir))
    kept = capture_source.answer_ttls(capture_source.read_records(spark, path, RANGE))
    out = common.cache_queries(capture_source.read_questions(spark, path, RANGE), kept)
    return out.groupBy("domain", "query_type", "query_class").agg(F.count(F.lit(1)).alias("responses"), F.count("ttl").alias("kept"), F.min("ttl").alias("shortest"), F.sum("ttl").alias("seconds"))


def _uploaded(table: str):
    """The report over packets and logs together: each event's name in one of them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("id") % len(ASKED) + 1).cast("int"))
        e = _dns(spark, sf_dir).withColumn("domain", asked)
        plain = e.where(F.col("domain").rlike(r"^([a-z0-9_-]{1,63}\.)+[a-z0-9_-]{1,63}$"))  # what labels can carry
        log = shared_folder(spark, "logs")
        zeek_log(e.join(plain.select("id"), "id", "left_anti"), log)
        rows = common.read_captured(spark, written(spark, plain.withColumn("id", F.col("id") * 2 + 1)), log, RANGE)
        return analysis.capture_report(rows)[table]

    return run


def queries() -> dict:
    return {"capture_ranges": _questions, "answer_records": _records, "answer_lifetimes": _lifetimes, "upload_totals": _uploaded("totals"), "upload_sources": _uploaded("sources")}


_D = f"with {DNS_EVENTS_SQL}, d as (select *, round(epoch_us(ts) / 1e6, 3) as timestamp, coalesce(client_address, '10.1.1.1') as source_ip from v_dns where event_type = 'dns')"
_RR = f"""{_D}, r as (
        select id, domain, query_type, timestamp, 'answer' as section, 0 as nth, 'A' as record_type, id * 7 % 400 as ttl, '10.' || (id // 65536 % 256) || '.' || (id // 256 % 256) || '.' || (id % 256) as data from d where id % 2 = 0 and id % 3 > 0
        union all select id, domain, query_type, timestamp, 'answer', 1, 'CNAME', id * 11 % 90, 'cdn.' || domain from d where id % 2 = 0 and id % 3 = 2
        union all select id, domain, query_type, timestamp, 'authority', (id % 3)::int, 'NS', id * 13 % 50, 'ns.' || domain from d where id % 4 = 0
    )"""
_UPLOAD = f"{_VERDICTS}, sent as (select *, coalesce(client_address, case when regexp_matches(key, '^([a-z0-9_-]{{1,63}}\\.)+[a-z0-9_-]{{1,63}}$') then '10.1.1.1' end) as source from asked)"
ORACLE_SQL = {
    "capture_ranges": f"{_D} select domain, query_type, source_ip, '192.0.2.53' as dest_ip, 'udp' as transport, timestamp, id % 2 = 0 as is_response, null::varchar as error from d",
    "answer_records": f"{_RR} select section, nth::int as nth, domain as name, record_type, 1 as record_class, ttl::bigint as ttl, data, timestamp from r",
    "answer_lifetimes": f"""{_RR}, kept as (select id, greatest(1, least(300, min(ttl))) as ttl from r where ttl > 0 group by 1)
        select domain, query_type, 'IN' as query_class, count(*) as responses, count(ttl) as kept, min(ttl) as shortest, sum(ttl)::bigint as seconds from d left join kept using (id) where id % 2 = 0 group by 1, 2""",
    "upload_totals": f"""{_UPLOAD} select (select count(*) from first) as names, (select count(*) from first) - count(*) as rejected, count(*) filter (where classification = 'MALICIOUS') as malicious,
        count(*) filter (where classification = 'SUSPICIOUS') as suspicious, count(*) filter (where classification = 'SAFE') as safe, count(*) filter (where decision = 'BLOCK') as blocked, count(*) filter (where decision = 'MONITOR') as monitored,
        count(*) filter (where dga_codes in ('DGA_HIGH', 'DGA_MODERATE')) as generated, count(*) filter (where indicators <> '') as tunnels, count(*) filter (where verdict in ('MALICIOUS', 'SUSPICIOUS')) as listed, (select count(*) from asked) as queries from verdicts""",
    "upload_sources": f"""{_UPLOAD} select coalesce(source, 'unknown') as source_ip, count(*) as queries, count(distinct s.key) as domains, count(*) filter (where decision = 'BLOCK') as blocked,
        count(*) filter (where decision = 'MONITOR') as monitored, count(*) filter (where decision = 'ALLOW') as allowed, round(100 * count(*) filter (where decision = 'BLOCK') / count(*), 1) as threat_rate
        from sent s left join verdicts v on s.key = v.key group by 1""",
}

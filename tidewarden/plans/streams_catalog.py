"""Queries over what streams keep up to date, and their SQL. The event table arrives file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.plans.views import DNS_EVENTS_SQL, as_dns, dns_events
from tidewarden.shared import shared_folder
from tidewarden.streaming import kept, live, sliding

#: Minutes: the test events are sparse.
PANE, WINDOW, STEP = 60, 1440, 360


def arriving(spark: SparkSession, sf_dir: str, files: int = 3) -> DataFrame:
    """The events as a stream, one file a micro-batch, in no order."""
    path, stored = shared_folder(spark, "arriving"), spark.read.parquet(f"{sf_dir}/events.parquet")
    stored.repartition(files).write.parquet(path)
    return as_dns(live.event_stream(spark, path, stored.schema, files=1)).withColumn("ts", F.col("ts").cast("timestamp"))


def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "panes")
    sliding.panes_into(arriving(spark, sf_dir), path, f"{path}-checkpoint", PANE, "10000 days", availableNow=True).awaitTermination()
    out = sliding.windows(sliding.stored_panes(spark, path), PANE, WINDOW, STEP)
    return out.withColumn("end", F.date_format("end", "yyyy-MM-dd HH:mm"))


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.exact_windows(dns_events(spark, sf_dir), WINDOW, STEP).withColumn("end", F.date_format("end", "yyyy-MM-dd HH:mm"))


def _kept(table: str, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, events = shared_folder(spark, "kept"), arriving(spark, sf_dir)
        kept.keep(kept.tables(events)[table], path, kept.TABLES[table], f"{path}-checkpoint", 2, availableNow=True).awaitTermination()
        return kept.dashboard(kept.current(spark, path, kept.TABLES[table]), name)

    return run


KEPT = {"kept_top_risky": ("domains", "top_risky"), "kept_top_blocked": ("domains", "top_blocked"), "kept_activity": ("hours", "activity"), "kept_sources": ("clients", "sources"), "kept_rates": ("measures", "rates")}


def queries() -> dict:
    return {"sliding_panes": _sliding, "sliding_exact": _exact} | {q: _kept(*of) for q, of in KEPT.items()}


_ENDS = f"""with {DNS_EVENTS_SQL}, s as (select *, epoch_us(ts) // 1000000 as sec from v_dns where registrable_domain is not null),
    b as (select min(sec) // {STEP * 60} * {STEP * 60} as low, max(sec) + {(WINDOW + 2 * STEP) * 60} as high from s), ends as (select low + i * {STEP * 60} as last from b, range(0, 100000) r(i) where low + i * {STEP * 60} <= high)"""
_AT = "strftime(make_timestamp(last * 1000000), '%Y-%m-%d %H:%M') as \"end\""
ORACLE_SQL = {
    "sliding_panes": f"""{_ENDS} select registrable_domain, {_AT}, count(*) as events, count(distinct domain) as distinct_names, max(risk_score) as max_risk, count(*) filter (where blocked) as blocked,
        count(*) filter (where response_code = 'NXDOMAIN' and not blocked) as nxdomain from ends join s on sec >= last - {WINDOW * 60} and sec < last group by 1, last""",
    "sliding_exact": f"""{_ENDS}, w as (select registrable_domain, last, count(*) as events, count(distinct domain) as distinct_names, count(*) filter (where sec >= last - {STEP * 60}) as fresh from ends join s on sec >= last - {WINDOW * 60} and sec < last group by 1, 2),
        gone as (select distinct registrable_domain, last from ends join s on sec >= last - {(WINDOW + STEP) * 60} and sec < last - {WINDOW * 60})
        select registrable_domain, {_AT}, events, distinct_names from w left join gone g using (registrable_domain, last) where fresh > 0 or g.last is not null""",
    "kept_rates": f"""with {DNS_EVENTS_SQL} select count(*) as events, count(*) filter (where event_type = 'dns') as dns_events, count(*) filter (where cache_hit) as cache_hits, count(*) filter (where upstream_used) as forwarded,
        round(count(*) filter (where cache_hit) / count(*) filter (where cache_hit or upstream_used), 3) as hit_rate, round(sum(analysis_time_ms) / count(*), 3) as mean_ms from v_dns""",
}

"""The event stream: the dashboards that move, the answer cache's hits, and verdicts that become history.

Events later than the watermark are left out of windows; the batch queries count them.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidewarden.operators.replay import replay
from tidewarden.policy import POLICY, Policy

WATERMARK = "10 minutes"
#: A verdict as it is stored; ``batch`` is the micro-batch's folder.
VERDICTS = (
    "id long, ts timestamp, domain string, registrable_domain string, event_type string, response_code string, behavioral_score double, raw_score double, risk_score int, "
    "decision string, blocked boolean, batch long"
)


def event_stream(spark: SparkSession, path: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder, at most ``files`` in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once(events: DataFrame, key: str = "id", watermark: str = WATERMARK) -> DataFrame:
    """Each event once, however often its source sent it within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def hourly_activity(events: DataFrame, column: str, values: list[str], watermark: str | None = WATERMARK) -> DataFrame:
    """Counts of each value, hour by hour. ``watermark``: None for events that have theirs already, as from ``once``."""
    cells = [F.count_if(F.col(column) == v).alias(v) for v in values]
    out = (events.withWatermark("ts", watermark) if watermark else events).groupBy(F.window("ts", "1 hour").alias("w")).agg(*cells)
    return out.select(F.date_format("w.start", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("hour"), *values)


def sliding_history(events: DataFrame, minutes: int = 60, step: int = 1, watermark: str = WATERMARK) -> DataFrame:
    """The history of each domain over the ``minutes`` that end at each step. Streams keep no exact distinct counts, so
    names are counted approximately; ``history.domain_histories`` is exact over the stored table."""
    w = F.window("ts", f"{minutes} minutes", f"{step} minutes").alias("w")
    failed = (F.col("response_code") == "NXDOMAIN") & ~F.col("blocked")
    out = events.withWatermark("ts", watermark).groupBy(w, "registrable_domain").agg(
        F.count(F.lit(1)).alias("events"), F.approx_count_distinct("domain").alias("distinct_names"), F.max("risk_score").alias("max_risk"),
        F.count_if("blocked").alias("blocked"), F.count_if(failed).alias("nxdomain"),
    )
    return out.withColumns({"start": F.col("w.start"), "end": F.col("w.end")}).drop("w")


def counters(events: DataFrame, name: str = "counters") -> DataFrame:
    """The same rows; the query's progress reports how many passed, were blocked, watched or answered from the cache."""
    return events.observe(
        name, F.count(F.lit(1)).alias("queries"), F.count_if(F.col("blocked")).alias("blocked"), F.count_if(F.col("decision") == "MONITOR").alias("monitored"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"), F.count_if(F.col("upstream_used")).alias("forwarded"),
    )


def cache_hits(queries: DataFrame, max_ttl: int = 300, watermark: str = WATERMARK) -> DataFrame:
    """Rows (id, name, query_type, cache_hit) of queries (id, ts, domain, query_type, query_class, ttl): whether a cache that
    is large enough answers each. An answer is kept for its ``ttl`` seconds, ``max_ttl`` at most; null or 0 isn't kept.

    Names count without case and final dots. The rows of a key in a micro-batch count in order of (ts, id) and are in one
    task, so bound micro-batches by the source's ``files``. The state of a key is one number, kept until the watermark passes it."""
    name = F.lower(F.regexp_replace("domain", r"\.+$", ""))
    keyed = queries.withWatermark("ts", watermark).select("id", "ts", F.unix_micros("ts").alias("us"), name.alias("name"), "query_type", "query_class", F.col("ttl").cast("double").alias("ttl"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["us", "id"])
        until, hits = (state.get[0] if state.exists else 0), []
        for now, ttl in zip(rows.us, rows.ttl, strict=True):
            hits.append(now < until)
            if now >= until and ttl > 0:
                until = int(now + 1_000_000 * max(1.0, min(ttl, max_ttl)))
        state.update((until,))
        state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"id": rows.id, "name": key[0], "query_type": key[1], "cache_hit": hits})

    grouped = keyed.groupBy("name", "query_type", "query_class")
    return grouped.applyInPandasWithState(step, "id long, name string, query_type string, cache_hit boolean", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def replay_into(events: DataFrame, path: str, checkpoint: str, minutes: int | None = None, policy: Policy = POLICY, **trigger) -> StreamingQuery:
    """Judges a stream of events (see ``replay.replay``) with the verdicts stored before as their history, and stores theirs,
    a folder for each micro-batch. A micro-batch that runs again replaces its own folder.

    An event that comes after younger ones has been judged doesn't change their verdicts. Only the stored rows of the
    window before a micro-batch are read."""
    span = minutes or policy.get("behavioral.window_minutes")

    def judge(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        before, first = None, batch.agg(F.min("ts")).first()[0]
        if number and first is not None:
            stored = batch.sparkSession.read.schema(VERDICTS).parquet(path)
            before = stored.where((F.col("batch") < number) & (F.col("ts") >= F.lit(first - datetime.timedelta(minutes=span))))
        replay(batch, span, before, policy).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(**trigger).start()

"""Tables that a stream keeps up to date: changed rows of each micro-batch are stored by key, and the last one of a key holds.

A micro-batch is a folder of its own, so one that runs again replaces what it had written. Every so many micro-batches the table
as it then stands is written as a snapshot, and a reader takes the last whole snapshot and the changes behind it; changes that
two snapshots cover are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewarden.plans import dashboards

#: Micro-batches between snapshots.
SNAPSHOT = 50


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """The finished folders below a path by the number in their names."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return {}
    done = [f.getPath() for f in fs.listStatus(top) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return {int(p.getName().split("=")[1]): p.toString() for p in done}


def _remove(spark: SparkSession, path: str) -> None:
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)


def current(spark: SparkSession, path: str, keys: list[str], upto: int | None = None) -> DataFrame | None:
    """The table as it stands, or as it stood after micro-batch ``upto``; None before the first one."""
    of = lambda kind: {n: p for n, p in _folders(spark, f"{path}/{kind}").items() if upto is None or n <= upto}
    snapshots, changes = of("snapshots"), of("changes")
    base = max(snapshots, default=-1)
    parts = [(n, p) for n, p in sorted(changes.items()) if n > base] + ([(base, snapshots[base])] if snapshots else [])
    if not parts:
        return None
    rows = [spark.read.parquet(p).withColumn("_batch", F.lit(n)) for n, p in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    last = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
    return out.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "_batch")


def keep(changes: DataFrame, path: str, keys: list[str], checkpoint: str, every: int = SNAPSHOT, **trigger) -> StreamingQuery:
    """Keeps the table of an aggregation over a stream (see ``current``); ``keys`` are the columns that it is grouped by."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if number % every == every - 1:
            current(spark, path, keys, number).write.mode("overwrite").parquet(f"{path}/snapshots/batch={number}")
            for n, p in _folders(spark, f"{path}/changes").items():
                if n <= number - every:
                    _remove(spark, p)
            for n, p in _folders(spark, f"{path}/snapshots").items():
                if n < number - every:
                    _remove(spark, p)

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


#: What the dashboards are read from: tables, and what they are grouped by.
TABLES = {"domains": ["domain"], "hours": ["hour"], "clients": ["client_address", "domain"], "measures": ["one"]}


def tables(events: DataFrame) -> dict[str, DataFrame]:
    """The aggregations that ``dashboard`` reads, over a stream or a table of events. State grows with domains, hours and pairs of
    client and domain, not with events."""
    risky, blocked = F.col("risk_score") >= 30, dashboards.is_dns() & F.col("blocked")
    top = F.struct("risk_score", "id", "classification", "query_type", "top_factors", "block_policy")
    count, count_if = F.count(F.lit(1)), F.count_if
    decided = lambda d: count_if(F.col("decision") == d)
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("hour")
    return {
        "domains": events.groupBy("domain").agg(F.max(F.when(risky, top)).alias("riskiest"), count_if(risky).alias("risky"), F.max(F.when(blocked, top)).alias("worst"), count_if(blocked).alias("blocked")),
        "hours": events.where(dashboards.is_dns()).groupBy(hour).agg(decided("ALLOW").alias("ALLOW"), decided("MONITOR").alias("MONITOR"), decided("BLOCK").alias("BLOCK")),
        "clients": events.where("client_address is not null").groupBy("client_address", "domain").agg(count.alias("queries"), count_if("blocked").alias("blocked"), decided("MONITOR").alias("monitored"), F.max("risk_score").alias("max_risk"), F.max("ts").alias("last_seen")),
        "measures": events.groupBy(F.lit(1).alias("one")).agg(count.alias("events"), count_if(dashboards.is_dns()).alias("dns_events"), count_if("cache_hit").alias("cache_hits"), count_if("upstream_used").alias("forwarded"), F.sum(F.col("analysis_time_ms")).alias("analysis_ms")),
    }


def keep_dashboards(events: DataFrame, path: str, every: int = SNAPSHOT, **trigger) -> list[StreamingQuery]:
    """Starts one query for each of ``TABLES``."""
    return [keep(df, f"{path}/{name}", TABLES[name], f"{path}/checkpoints/{name}", every, **trigger) for name, df in tables(events).items()]


def dashboard(kept: DataFrame, name: str, k: int | None = None) -> DataFrame:
    """A dashboard from its kept table: top_risky, top_blocked (domains), activity (hours), sources (clients), rates (measures). They
    equal those of ``dashboards`` over all events that have arrived."""
    if name == "top_risky":
        out = kept.where("risky > 0").select("domain", "riskiest.risk_score", "riskiest.classification", F.col("risky").alias("hits"))
        return out.orderBy(F.desc("risk_score"), F.desc("hits"), "domain").limit(k or 10)
    if name == "top_blocked":
        reason = dashboards.first_label(F.col("worst.top_factors")).alias("reason")
        out = kept.where("blocked > 0").select("domain", "worst.risk_score", "worst.query_type", reason, F.col("worst.block_policy").alias("policy"), F.col("blocked").alias("hits"))
        return out.orderBy(F.desc("hits"), F.desc("risk_score"), "domain").limit(k or 15)
    if name == "activity":
        return kept.select("hour", "ALLOW", "MONITOR", "BLOCK")
    if name == "sources":
        out = kept.groupBy("client_address").agg(
            F.sum("queries").alias("queries"), F.count(F.lit(1)).alias("domains"), F.sum("blocked").alias("blocked"), F.sum("monitored").alias("monitored"), F.max("max_risk").alias("max_risk"), F.max("last_seen").alias("last_seen"),
        )
        out = out.withColumn("threat_rate", F.round(100 * F.col("blocked") / F.col("queries"), 1))
        return out.orderBy(F.desc("blocked"), F.desc("queries"), "client_address").limit(k or 50)
    if name == "rates":
        looked = F.col("cache_hits") + F.col("forwarded")
        return kept.select("events", "dns_events", "cache_hits", "forwarded", F.when(looked > 0, F.round(F.col("cache_hits") / looked, 3)).otherwise(0.0).alias("hit_rate"), F.round(F.col("analysis_ms") / F.col("events"), 3).alias("mean_ms"))
    raise ValueError(f"no such dashboard: {name}")


#: Counters of one micro-batch, as ``live.counters`` observes them.
COUNTERS = "query string, batch long, queries long, blocked long, monitored long, cache_hits long, forwarded long"


class CounterListener(StreamingQueryListener):
    """Stores the counters of every micro-batch; add it with ``spark.streams.addListener``. A micro-batch that runs again is stored
    again, and ``counted`` takes the last."""

    def __init__(self, spark: SparkSession, path: str, name: str = "counters"):
        self.spark, self.path, self.name = spark, path, name

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            values = row.asDict()
            one = (str(event.progress.id), event.progress.batchId, *(values[c.split()[0]] for c in COUNTERS.split(", ")[2:]))
            self.spark.createDataFrame([one], COUNTERS).withColumn("stored", F.current_timestamp()).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def counted(spark: SparkSession, path: str) -> DataFrame:
    """The counters by micro-batch, with hit_rate (hits of all lookups) of the micro-batch and of all so far."""
    last = Window.partitionBy("query", "batch").orderBy(F.desc("stored"))
    so_far = Window.partitionBy("query").orderBy("batch")
    rate = lambda hits, others: F.when(hits + others > 0, F.round(hits / (hits + others), 3)).otherwise(0.0)
    rows = spark.read.schema(f"{COUNTERS}, stored timestamp").parquet(path).withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "stored")
    hits, others = F.col("cache_hits"), F.col("forwarded")
    return rows.withColumns({"hit_rate": rate(hits, others), "hit_rate_so_far": rate(F.sum(hits).over(so_far), F.sum(others).over(so_far))})

"""The stored event table: Parquet, a folder for each batch, one row for each decision.

Writing a batch again replaces it, so a retried job or micro-batch changes nothing. Columns are only ever added: files
written before a column existed read as null there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidewarden.operators.fusion import top_factors

#: What the caller's connection adds to a decision; null for plain analyses.
GATEWAY = {
    "query_type": "string", "query_class": "string", "client_address": "string", "upstream_used": "boolean", "cache_hit": "boolean", "response_code": "string",
    "block_policy": "string", "dns_upstream_time_ms": "double", "total_gateway_time_ms": "double",
}
SCHEMA = (
    "id bigint, ts timestamp, domain string, registrable_domain string, risk_score int, classification string, decision string, confidence double, ti_verdict string, "
    "ti_categories array<string>, ti_indicator string, dga_score double, lexical_score double, analysis_time_ms double, "
    "top_factors array<struct<code:string,severity:string,contribution:double>>, overrides_applied array<string>, source string, name_kind string, event_type string, blocked boolean, "
) + ", ".join(f"{c} {t}" for c, t in GATEWAY.items())

#: Ids are unique without a sort or a count: a batch has at most so many partitions, and its number leads the id.
PARTITIONS, ID_BITS = 1024, 43

# What a blocked query is answered with, by policy.
BLOCK_ANSWERS = {"NXDOMAIN": "NXDOMAIN", "REFUSED": "REFUSED"}


def answered(df: DataFrame, policy: str = "NXDOMAIN") -> DataFrame:
    """Blocked queries get the policy's response code, and its name; others keep theirs."""
    if policy not in BLOCK_ANSWERS:
        raise ValueError(f"no such block policy: {policy}")
    blocked = F.col("decision") == "BLOCK"
    return df.withColumns({"response_code": F.when(blocked, BLOCK_ANSWERS[policy]).otherwise(F.col("response_code")), "block_policy": F.when(blocked, policy)})


def decisions(analyzed: DataFrame, ts: Column | None = None, source: str = "batch", dns: bool = False) -> DataFrame:
    """Rows of the event table, but for the id, from analysed names; names that are none are left out.

    ``dns``: they are queries of clients, whose columns of ``GATEWAY`` are taken where they exist."""
    a = F.col("assessment")
    have = set(analyzed.columns)
    gateway = {c: (F.col(c) if dns and c in have else F.lit(None)).cast(t).alias(c) for c, t in GATEWAY.items()}
    spent = F.col("analysis_time_ms") if "analysis_time_ms" in have else F.lit(None)
    return analyzed.where("name.error_code is null").select(
        (F.current_timestamp() if ts is None else ts).alias("ts"), F.col("name.domain").alias("domain"), F.col("name.registrable_domain").alias("registrable_domain"),
        a["score"].alias("risk_score"), a["classification"].alias("classification"), a["decision"].alias("decision"), F.round(a["confidence"], 3).alias("confidence"),
        F.col("intel.verdict").alias("ti_verdict"), F.col("intel.categories").alias("ti_categories"), F.col("intel.indicator").alias("ti_indicator"),
        F.round(F.coalesce("dga.score", F.lit(0.0)) / 100, 4).alias("dga_score"), F.round(F.coalesce("lexical.score", F.lit(0.0)), 2).alias("lexical_score"),
        spent.cast("double").alias("analysis_time_ms"), top_factors(a["factors"]).alias("top_factors"), a["overrides"].alias("overrides_applied"),
        F.lit(source).alias("source"), F.col("cls.kind").alias("name_kind"), F.lit("dns" if dns else "analysis").alias("event_type"),
        (F.lit(dns) & (a["decision"] == "BLOCK")).alias("blocked"), *gateway.values(),
    )


def append(events: DataFrame, path: str, batch: int) -> None:
    """Writes ``events`` as batch number ``batch``, in place of what that batch held; columns that they lack are null."""
    if not 0 <= batch < 1 << (63 - ID_BITS):
        raise ValueError("batch numbers are 0 to 2**20 - 1")
    rows = events.coalesce(PARTITIONS)
    have = set(rows.columns)
    columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(SCHEMA) if f.name != "id"]
    unique = F.lit(batch << ID_BITS).cast("long") + F.monotonically_increasing_id()
    rows.select(unique.alias("id"), *columns).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All stored events; flags that were never written are false, lists are empty."""
    stored = spark.read.schema(SCHEMA).parquet(path)
    defaults = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("blocked", "upstream_used", "cache_hit")}
    lists = {c: F.coalesce(F.col(c), F.array().cast(stored.schema[c].dataType)) for c in ("ti_categories", "top_factors", "overrides_applied")}
    return stored.withColumns(defaults | lists | {"event_type": F.coalesce("event_type", F.lit("analysis"))}).drop("batch")


def clear(spark: SparkSession, path: str) -> int:
    """Empties the table; returns how many events it had."""
    n = spark.read.schema(SCHEMA).parquet(path).count()
    empty = spark.createDataFrame([], SCHEMA + ", batch int")
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("batch").parquet(path)
    return n


def stream_into(events: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, **trigger) -> StreamingQuery:
    """Stores a stream of events, each micro-batch once; ``prepare`` may analyse it first. ``trigger``: as in Spark."""
    writer = events.writeStream.foreachBatch(lambda df, n: append(prepare(df), path, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


# The names that an interface gives the columns of an event; other columns keep theirs.
SHOWN_AS = {"ts": "timestamp", "ti_verdict": "threat_intelligence_verdict", "ti_categories": "threat_categories", "ti_indicator": "matched_indicator"}


def projected(events: DataFrame) -> DataFrame:
    """Stored events as an interface shows them: its names and order of columns; flags are false and lists empty where unset."""
    names = [f.name for f in StructType.fromDDL(SCHEMA)]
    order = [c for c in names if c not in ("name_kind", "event_type", "blocked", *GATEWAY)] + ["event_type", "query_type", "query_class", "client_address", "blocked", "upstream_used", "cache_hit", "response_code", "block_policy", "dns_upstream_time_ms", "total_gateway_time_ms"]
    return events.select(*(F.col(c).alias(SHOWN_AS.get(c, c)) for c in order))


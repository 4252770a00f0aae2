"""One record for all captures, whatever they were read from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.sources import capture_source, zeek

#: The columns of a captured query; ``seq`` orders rows of all files.
COLUMNS = ("path", "seq", "domain", "query_type", "source_ip", "dest_ip", "transport", "timestamp", "is_response", "rcode")


def _ordered(rows: DataFrame, first, second) -> DataFrame:
    seq = F.struct("path", first.cast("long").alias("place"), second.cast("long").alias("nth"))
    rcode = F.col("rcode") if "rcode" in rows.columns else F.lit(None).cast("string").alias("rcode")
    return rows.withColumn("seq", seq).select(*(rcode if c == "rcode" else c for c in COLUMNS))


def read_captured(spark: SparkSession, packets: str | None = None, logs: str | None = None, range_bytes: int = capture_source.RANGE) -> DataFrame:
    """Rows of ``COLUMNS`` of packet captures and of Zeek logs, either or both; columns that a source doesn't have are null."""
    parts = []
    if packets:
        rows = capture_source.read_questions(spark, packets, range_bytes).where("error is null")
        parts.append(_ordered(rows, F.shiftright("seq", capture_source.SEQ_BITS), F.col("seq").bitwiseAND((1 << capture_source.SEQ_BITS) - 1)))
    if logs:
        parts.append(_ordered(zeek.read_zeek(spark, logs), F.col("seq.block"), F.col("seq.line")))
    if not parts:
        raise ValueError("no source was named")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def capture_errors(spark: SparkSession, packets: str | None = None, logs: str | None = None) -> DataFrame:
    """Rows (path, error), one for each file that can't be read."""
    parts = []
    if packets:
        parts.append(capture_source.read_questions(spark, packets).where("error is not null").select("path", "error"))
    if logs:
        parts.append(zeek.zeek_errors(spark, logs))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def cache_queries(questions: DataFrame, ttls: DataFrame) -> DataFrame:
    """Rows (id, ts, domain, query_type, query_class, ttl) of responses, as ``streaming.live.cache_hits`` takes them: each question with
    how long its answer is kept (null: not at all). ``ttls``: see ``capture_source.answer_ttls``."""
    message = F.shiftleft(F.shiftright("seq", capture_source.SEQ_BITS), capture_source.SEQ_BITS)
    asked = questions.where("is_response and error is null").withColumn("message", message)
    out = asked.join(ttls.select("path", F.col("seq").alias("message"), "ttl"), ["path", "message"], "left")
    return out.select(F.xxhash64("path", "seq").alias("id"), F.timestamp_seconds("timestamp").alias("ts"), "domain", "query_type", F.lit("IN").alias("query_class"), "ttl")

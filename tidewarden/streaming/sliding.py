"""Sliding windows over a stream from panes: an event is counted once, in its pane, and windows are merged from panes.

A pane of a domain holds its counts and a mergeable sketch of its names, so state and store grow with panes, not with windows
an event lies in. Distinct names of merged sketches are estimates (``RELATIVE_ERROR``); ``exact_windows`` counts them
exactly over the stored events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewarden.streaming import kept

KEY = "registrable_domain"
WATERMARK = "10 minutes"
#: Log2 of a sketch's registers, and the standard error that goes with it (1.04 over the root of the registers).
REGISTERS = 12
RELATIVE_ERROR = 1.04 / 2 ** (REGISTERS / 2)


def _failed() -> Column:
    return F.coalesce((F.col("response_code") == "NXDOMAIN") & ~F.col("blocked"), F.lit(False))


def panes(events: DataFrame, minutes: int = 1, watermark: str | None = WATERMARK) -> DataFrame:
    """Rows (registrable_domain, pane, events, names, max_risk, blocked, nxdomain) of a stream or a table; ``names`` is a sketch, ``pane`` the
    pane's start."""
    if watermark and events.isStreaming:
        events = events.withWatermark("ts", watermark)
    out = events.where(f"{KEY} is not null").groupBy(F.window("ts", f"{minutes} minutes").alias("w"), KEY).agg(
        F.count(F.lit(1)).alias("events"), F.hll_sketch_agg("domain", F.lit(REGISTERS)).alias("names"), F.max("risk_score").alias("max_risk"), F.count_if("blocked").alias("blocked"), F.count_if(_failed()).alias("nxdomain"),
    )
    return out.select(KEY, F.col("w.start").alias("pane"), "events", "names", "max_risk", "blocked", "nxdomain")


def panes_into(events: DataFrame, path: str, checkpoint: str, minutes: int = 1, watermark: str = WATERMARK, **trigger) -> StreamingQuery:
    """Keeps the panes of a stream as they grow (see ``kept``); ``stored_panes`` reads them."""
    return kept.keep(panes(events, minutes, watermark), path, [KEY, "pane"], checkpoint, **trigger)


def stored_panes(spark: SparkSession, path: str) -> DataFrame | None:
    return kept.current(spark, path, [KEY, "pane"])


def _ends(start: Column, pane: int, window: int, step: int) -> Column:
    """The ends, in seconds, of the windows that hold a pane: multiples of ``step`` from the pane's end to its start and the window."""
    at = F.unix_seconds(start.cast("timestamp"))
    first = F.ceil((at + pane * 60) / (step * 60)) * (step * 60)
    return F.sequence(first.cast("long"), (F.floor((at + window * 60) / (step * 60)) * (step * 60)).cast("long"), F.lit(step * 60).cast("long"))


def windows(stored: DataFrame, pane: int = 1, window: int = 60, step: int = 1) -> DataFrame:
    """Rows (registrable_domain, end, events, distinct_names, max_risk, blocked, nxdomain), one for each domain and window of ``window`` minutes that
    holds any of its panes; windows end at multiples of ``step`` minutes, both multiples of ``pane``, the minutes of a pane."""
    _check(pane, window, step)
    dealt = stored.withColumn("end", F.explode(_ends(F.col("pane"), pane, window, step)))
    out = dealt.groupBy(KEY, "end").agg(
        F.sum("events").alias("events"), F.hll_sketch_estimate(F.hll_union_agg("names")).alias("distinct_names"), F.max("max_risk").alias("max_risk"), F.sum("blocked").alias("blocked"), F.sum("nxdomain").alias("nxdomain"),
    )
    return out.withColumn("end", F.timestamp_seconds("end"))


def _check(pane: int, window: int, step: int) -> None:
    if window % pane or step % pane:
        raise ValueError("windows and steps must be whole panes")


def exact_windows(events: DataFrame, window: int = 60, step: int = 1) -> DataFrame:
    """Rows (registrable_domain, end, events, distinct_names), exact, for the windows of ``windows`` at whose end something changed for the
    domain, none without events.

    A name is in the windows that end from its row's step on until the window after its last row; overlapping spans are one.
    So each name adds one where a span begins and takes it away where it ends, and running sums of these changes are the
    distinct names. A domain's changes are summed by step first, so a busy domain is as many rows as it has steps."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    step_s, span = step * 60, window * 60
    begin = ((F.floor(at / step_s) + 1) * step_s).cast("long")  # the first end behind the row
    leave = ((F.floor((at + span) / step_s) + 1) * step_s).cast("long")  # the first end whose window it has left
    rows = events.where(f"{KEY} is not null").groupBy(KEY, "domain", begin.alias("begin"), leave.alias("leave")).agg(F.count(F.lit(1)).alias("n"))
    by_name = Window.partitionBy(KEY, "domain").orderBy("begin")
    before = F.max("leave").over(by_name.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("begin").over(by_name)
    named = F.col("domain").isNotNull()
    marked = rows.select(KEY, "begin", "leave", "n", (named & (before.isNull() | (before < F.col("begin")))).cast("int").alias("comes"), (named & (after.isNull() | (after > F.col("leave")))).cast("int").alias("goes"))
    changes = marked.select(KEY, F.explode(F.array(F.struct(F.col("begin").alias("end"), F.col("n").alias("n"), F.col("comes").alias("names")), F.struct(F.col("leave").alias("end"), (-F.col("n")).alias("n"), (-F.col("goes")).alias("names")))).alias("c"))
    summed = changes.groupBy(KEY, "c.end").agg(F.sum("c.n").alias("n"), F.sum("c.names").alias("names"))
    so_far = Window.partitionBy(KEY).orderBy("end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = summed.select(KEY, F.timestamp_seconds("end").alias("end"), F.sum("n").over(so_far).alias("events"), F.sum("names").over(so_far).alias("distinct_names"))
    return out.where("events > 0")

"""Verdicts over a stream by keyed state: each domain keeps the events of its window, with their verdicts.

Nothing is read back from what was stored, and no micro-batch is judged in rounds: an event is judged once, by the state of
its domain, and joins it. A domain's state is forgotten when the watermark has passed its last event's window.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewarden.operators import fusion, scorers
from tidewarden.operators.replay import EVIDENCE, KEY, NEEDED, TERM_NAMES, assessed, facts, walk, with_evidence
from tidewarden.policy import POLICY, Policy

WATERMARK = "10 minutes"
#: An event in the state, and what comes out of the walk beside the event itself.
STATE = "us long, name string, dns boolean, missing boolean, blocked boolean"
COUNTED = "event string, evidence string, total long, distinct_names long, nxdomain long, blocked long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_Row = namedtuple("_Row", ["us", "name", "dns", "missing", *TERM_NAMES])


class Judge(StatefulProcessor):
    """The state of a domain: the events of the window before the watermark, and those after it."""

    def __init__(self, minutes: int, policy: Policy):
        self.span, self.policy = minutes * 60_000_000, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getListState("past", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["us", "id"], kind="stable")
        new = new.astype(object).where(new.notna(), None)
        held = [(_Row(*r[:4], *[None] * len(TERM_NAMES)), r[4], None) for r in self.past.get()]
        held += [(_Row(*(getattr(r, c) for c in _Row._fields)), None, i) for i, r in enumerate(new.itertuples(index=False))]
        held.sort(key=lambda x: x[0].us)
        events, verdicts, counts = [r for r, _, _ in held], [v for _, v, _ in held], {}
        for i, found in walk(events, verdicts, self.span, self.policy):
            counts[held[i][2]] = found
        self._keep([(int(r.us), r.name, bool(r.dns), bool(r.missing), bool(v)) for r, v in zip(events, verdicts, strict=True)], timerValues.getCurrentWatermarkInMs())
        total, names, missing, blocked = zip(*(counts[i] for i in range(len(new))), strict=True)
        yield pd.DataFrame({"event": new["event"].tolist(), "evidence": new["evidence"].tolist(), "total": total, "distinct_names": names, "nxdomain": missing, "blocked": blocked})

    def _keep(self, events: list[tuple], watermark: int) -> None:
        """The events that later ones may look back on: none of these is older than the watermark."""
        events = [e for e in events if e[0] >= watermark * 1000 - self.span]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if events:
            self.past.put(events)
            self.handle.registerTimer(max(max(e[0] for e in events) + self.span, watermark * 1000) // 1000 + 1)
        else:
            self.past.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(list(self.past.get()), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def counted(events: DataFrame, minutes: int | None = None, policy: Policy = POLICY, watermark: str = WATERMARK) -> DataFrame:
    """The columns of ``NEEDED`` and ``EVIDENCE`` of a stream of events, with each event's history: total, distinct_names, nxdomain and
    blocked, as ``scorers.behavioral`` reads them.

    Events of a micro-batch are judged in order of (ts, id), each by what its domain's earlier events, of any micro-batch, came to.
    One that comes after younger ones were judged doesn't change their verdicts; one later than the watermark is left
    out, as in windows (``live.replay_into`` judges it). Events without a registrable domain have no history. The session's
    state store must be RocksDB: ``spark.sql.streaming.stateStore.providerClass`` = ``PROVIDER``."""
    minutes = minutes or policy.get("behavioral.window_minutes")
    rows = with_evidence(events.withWatermark("ts", watermark))
    spare = F.when(F.col(KEY).isNull(), F.concat(F.lit("#"), F.xxhash64("id", "ts").cast("string")))  # alone
    keyed = rows.select(
        "ts", "id", F.coalesce(KEY, spare).alias("key"), F.to_json(F.struct(*(F.unix_micros(F.col("ts").cast("timestamp")).alias(c) if c == "ts" else F.col(c) for c in NEEDED))).alias("event"),
        F.to_json(F.struct(*EVIDENCE)).alias("evidence"), *facts(policy),
    )
    out = keyed.groupBy("key").transformWithStateInPandas(Judge(minutes, policy), COUNTED, "append", "eventTime")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in NEEDED}
    event = F.from_json("event", ", ".join(f"{c} {'bigint' if c == 'ts' else kinds[c]}" for c in NEEDED))
    evidence = F.from_json("evidence", ", ".join(f"{c} {scorers.SIGNAL}" for c in EVIDENCE))
    return out.withColumns({"_e": event, "_s": evidence}).select(
        *(F.timestamp_micros("_e.ts").alias(c) if c == "ts" else F.col(f"_e.{c}").alias(c) for c in NEEDED), *(F.col(f"_s.{c}").alias(c) for c in EVIDENCE), "total", "distinct_names", "nxdomain", "blocked"
    )


def judge_into(events: DataFrame, path: str, checkpoint: str, minutes: int | None = None, policy: Policy = POLICY, watermark: str = WATERMARK, **trigger) -> StreamingQuery:
    """Stores rows of ``replay.replay``, a folder for each micro-batch; a micro-batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        out = fusion.assess(scorers.behavioral(batch, policy), policy)
        out.select(*NEEDED, *assessed(out, policy)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counted(events, minutes, policy, watermark).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()

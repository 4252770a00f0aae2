"""Events judged in order of time, where each verdict is part of the history of the later ones.

A blocked query counts as such for its domain, and its answer no longer counts as missing, so a verdict may change those
after it. A domain's time is cut into slices as long as the window. A slice is walked in order, by the verdicts of the slice
before it, which hold its whole history; all slices at once, at first with verdicts that know no history. Slices whose
predecessor came out otherwise than they had taken it are walked again, until there are none. So a busy domain is many tasks,
a task holds two slices of one domain, and only what a changed verdict reaches is done twice.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.operators import fusion, history, scorers
from tidewarden.policy import POLICY, Policy
from tidewarden.shared import settle

KEY = "registrable_domain"
NEEDED = ("id", "ts", "domain", KEY, "event_type", "response_code")
EVIDENCE = ("ti", "dga", "lexical", "tunnel")
#: What a walk reads of a row, and what it writes.
TERM_NAMES = [t.split()[0] for t in fusion.TERMS.split(", ")]
WALKED = "key string, slice long, us long, row long, name string, dns boolean, missing boolean, blocked boolean, signature string, before string"
ROWS = 10_000


def with_evidence(events: DataFrame) -> DataFrame:
    """The columns of ``NEEDED`` and ``EVIDENCE``; a signal that is absent is null."""
    none = F.lit(None).cast(scorers.SIGNAL)
    return events.select(*NEEDED, *(F.col(c) if c in events.columns else none.alias(c) for c in EVIDENCE))


def facts(policy: Policy = POLICY) -> list[Column]:
    """What a walk needs of each row of ``with_evidence``, but for its key and place."""
    failed = F.coalesce(F.col("response_code") == "NXDOMAIN", F.lit(False))
    return [F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("domain").alias("name"), (F.col("event_type") == "dns").alias("dns"), failed.alias("missing"), *fusion.terms(policy)]


class Window:
    """Counts of the rows of a trailing window as they come and leave."""

    def __init__(self):
        self.names, self.others = Counter(), Counter()
        self.dns = self.blocked = self.missing = 0

    def add(self, r, blocked: bool, sign: int = 1) -> None:
        self.dns += sign * bool(r.dns)
        self.blocked += sign * bool(blocked)
        self.missing += sign * bool(r.missing and not blocked)
        for names in (self.names, self.others) if not r.dns else (self.names,):
            if r.name is not None:
                names[r.name] += sign
                if not names[r.name]:
                    del names[r.name]

    def counts(self) -> tuple[int, int, int, int]:
        """(total, distinct names, missing, blocked), in the order that ``scorers.behaved`` takes them."""
        return self.dns + len(self.others), len(self.names), self.missing, self.blocked


def walk(rows: list, verdicts: list[bool | None], span: int, policy: Policy) -> Iterator[tuple[int, tuple[int, int, int, int]]]:
    """(place, counts of its window) of each row without a verdict, which gets one. Rows are in order of time; those of the same
    microsecond don't see each other."""
    window, first, seen = Window(), 0, 0
    for i, r in enumerate(rows):
        while seen < i and rows[seen].us < r.us:
            window.add(rows[seen], verdicts[seen])
            seen += 1
        while first < seen and rows[first].us < r.us - span:
            window.add(rows[first], verdicts[first], -1)
            first += 1
        if verdicts[i] is None:
            counts = window.counts()
            verdicts[i] = bool(r.dns) and fusion.blocks(r, *scorers.behaved(*counts, policy), policy)
            yield i, counts


def _grouped(frames: Iterator[pd.DataFrame]) -> Iterator[list]:
    """Rows of each key and slice, which lie together."""
    held: list = []
    for frame in frames:
        frame = frame.astype(object).where(frame.notna(), None)
        for r in frame.itertuples(index=False):
            if held and (held[0].key, held[0].slice) != (r.key, r.slice):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _signature(verdicts: list[bool]) -> str:
    return hashlib.blake2b(bytes(verdicts), digest_size=12).hexdigest()


def _walked(own: DataFrame, context: DataFrame, span: int, policy: Policy) -> DataFrame:
    """Rows of ``WALKED`` for the rows of ``own``. ``context``: rows of the slices before, with the number of the slice that they
    are history of; their verdicts are those given, or else those without history."""
    rows = own.withColumn("own", F.lit(True)).unionByName(context.withColumn("own", F.lit(False)), allowMissingColumns=True)
    dealt = rows.repartition("key", "slice").sortWithinPartitions("key", "slice", "us", "row")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in _grouped(frames):
            plain = lambda r: bool(r.dns) and fusion.blocks(r, 0.0, 0.0, policy)
            verdicts = [None if r.own and r.blocked is None else plain(r) if r.blocked is None else bool(r.blocked) for r in group]
            for _ in walk(group, verdicts, span, policy):
                pass
            mine = [i for i, r in enumerate(group) if r.own]
            signature, before = _signature([verdicts[i] for i in mine]), _signature([plain(group[i]) if group[i].blocked is None else bool(group[i].blocked) for i in mine])
            out += [(*(getattr(group[i], c) for c in ("key", "slice", "us", "row", "name", "dns", "missing")), verdicts[i], signature, before) for i in mine]
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in WALKED.split(", ")])
                out = []
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in WALKED.split(", ")])

    return dealt.mapInPandas(run, WALKED)


def verdicts(rows: DataFrame, minutes: int, policy: Policy = POLICY) -> DataFrame:
    """Rows (row, verdict) for the rows (row, key, us, name, dns, missing, blocked, and those of ``fusion.TERMS``); ``blocked`` is a
    verdict that stands, or null. Rows without a key aren't walked."""
    span = minutes * 60_000_000
    base = settle(rows.where("key is not null").withColumn("slice", F.floor(F.col("us") / span)), "slices")
    following = lambda df: df.withColumn("slice", F.col("slice") + 1)
    turns, own, context = [], base, following(base)
    while True:
        slices = own.select("key", "slice").distinct()
        turns.append(settle(_walked(own, context.join(slices, ["key", "slice"], "left_semi"), span, policy), "walked"))
        each = [t.select("key", "slice", "signature", "before", F.lit(i).alias("turn")).distinct() for i, t in enumerate(turns)]
        known = each[0]
        for t in each[1:]:
            known = known.unionByName(t)
        now = F.max_by("signature", "turn").alias("signature")
        before = each[0].select("key", "slice", F.col("before").alias("taken")) if len(turns) == 1 else known.where(F.col("turn") < len(turns) - 1).groupBy("key", "slice").agg(F.max_by("signature", "turn").alias("taken"))
        changed = each[-1].select("key", "slice", "signature").join(before, ["key", "slice"]).where("signature <> taken").select("key", "slice")
        again = settle(following(changed).join(base.select("key", "slice").distinct(), ["key", "slice"], "left_semi"), "again")
        if again.isEmpty():
            break
        own = base.join(again, ["key", "slice"], "left_semi")
        context = following(turns[-1].drop("signature", "before"))
    last = known.groupBy("key", "slice").agg(F.max("turn").alias("turn"), now)
    every = turns[0].withColumn("turn", F.lit(0))
    for i, t in enumerate(turns[1:], 1):
        every = every.unionByName(t.withColumn("turn", F.lit(i)))
    return every.join(last.select("key", "slice", "turn"), ["key", "slice", "turn"]).select("row", F.col("blocked").alias("verdict"))


def assessed(past: DataFrame, policy: Policy = POLICY) -> list[Column]:
    """Columns of the outcome, for rows with ``assessment`` and ``behavioral``."""
    a = F.col("assessment")
    blocked = F.coalesce((F.col("event_type") == "dns") & (a["decision"] == "BLOCK"), F.lit(False))
    return [F.col("behavioral.score").alias("behavioral_score"), a["raw_score"].alias("raw_score"), a["score"].alias("risk_score"), a["decision"].alias("decision"), blocked.alias("blocked")]


def replay(events: DataFrame, minutes: int | None = None, settled: DataFrame | None = None, policy: Policy = POLICY) -> DataFrame:
    """Rows (id, ts, domain, registrable_domain, event_type, response_code, behavioral_score, raw_score, risk_score, decision,
    blocked), one for each event (the first six columns, and a signal for each of ``EVIDENCE``; one that is absent or null
    abstains). ``response_code``: the answer that the name has when it isn't blocked.

    History are the ``minutes`` before an event; events of the same microsecond don't see each other. Rows without a
    registrable domain have none. ``settled``: earlier rows of this form, which are history and keep their verdicts.
    Other columns are left out; no events give no rows."""
    minutes = minutes or policy.get("behavioral.window_minutes")
    rows = with_evidence(events).withColumn("stands", F.lit(None).cast("boolean"))
    if settled is not None:
        rows = rows.unionByName(settled.select(*NEEDED, F.col("blocked").alias("stands")), allowMissingColumns=True)
    stored = settle(rows.withColumn("row", F.monotonically_increasing_id()), "events")
    found = verdicts(stored.select("row", F.col(KEY).alias("key"), F.col("stands").alias("blocked"), *facts(policy)), minutes, policy)
    known = stored.join(found, "row", "left").withColumns({"blocked": F.coalesce("verdict", "stands", F.lit(False)), "risk_score": F.lit(0)})
    past = history.trailing(known, minutes)  # counts by the verdicts that hold
    has = F.col(KEY).isNotNull()
    counts = {"total": "total", "distinct_names": "distinct_names", "nxdomain": "nxdomain", "blocked": "blocked_before"}
    past = past.where("stands is null").withColumns({c: F.when(has, F.col(x)).otherwise(0) for c, x in counts.items()})
    return fusion.assess(scorers.behavioral(past, policy), policy).select(*NEEDED, *assessed(past, policy))

"""Verdicts that become history: batch and stream against a walk in order of time."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewarden.operators import fusion, replay, scorers
from tidewarden.plans.feeds_catalog import evidence
from tidewarden.streaming import live, verdicts

START = datetime.datetime(2024, 1, 1)
SCHEMA = "id long, ts timestamp, domain string, registrable_domain string, event_type string, response_code string, risk_score int, extra string"


def made(n: int) -> list[tuple]:
    out = []
    for i in range(n):
        domain = None if i % 17 == 0 else f"d{i % 3}.test"
        out.append((i, START + datetime.timedelta(minutes=i * 2 + i % 2), f"h{i * i % 11}.d{i % 3}.test", domain, "analysis" if i % 13 == 0 else "dns", None if i % 7 == 0 else "NXDOMAIN" if i % 2 else "NOERROR", (i * 37) % 90, "x"))
    return out


def walked(rows: list[tuple], minutes: int) -> dict[int, tuple]:
    past, out = [], {}
    for i, ts, name, domain, kind, code, risk, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        seen = [p for p in past if domain and p[1] == domain and ts - datetime.timedelta(minutes=minutes) <= p[0] < ts]
        total = sum(p[3] for p in seen) + len({p[2] for p in seen if not p[3]})
        missing = sum(p[4] and not p[5] for p in seen)
        points = 26 * (total >= 20) + 30 * (len({p[2] for p in seen}) >= 8) + 22 * (total >= 5 and missing / total >= 0.5) + 20 * (sum(p[5] for p in seen) >= 3) if total >= 3 else 0
        weight = 0.1 * min(0.85, 0.5 + 0.01 * total) if points else 0.0
        raw = min(100.0, (0.2125 * risk + weight * points) / (0.2125 + weight) + 8 * (risk >= 70 and points >= 70))
        blocked = kind == "dns" and round(raw) >= 70
        past.append((ts, domain, name, kind == "dns", code == "NXDOMAIN", blocked))
        out[i] = (points, round(raw, 6), blocked)
    return out


def found(df) -> dict[int, tuple]:
    return {r.id: (r.behavioral_score, round(r.raw_score, 6), r.blocked) for r in df.collect()}


def test_replay_equals_a_walk(spark):
    rows = made(150)
    want = walked(rows, 90)
    first = {r[0]: r[6] >= 70 and r[4] == "dns" for r in rows}
    assert any(want[i][2] != first[i] for i in first)  # history turns some verdicts
    assert found(replay.replay(evidence(spark.createDataFrame(rows, SCHEMA)), 90)) == want


def test_replay_of_nothing_and_without_evidence(spark):
    assert replay.replay(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = spark.createDataFrame(made(5), SCHEMA)
    assert {(r.behavioral_score, r.raw_score, r.decision, r.blocked) for r in replay.replay(rows).collect()} == {(0.0, 0.0, "ALLOW", False)}


@pytest.mark.parametrize("cut", [(60, 61)])
def test_stream_equals_a_walk(spark, tmp_path, cut):
    rows = made(100)
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for a, b in zip((0, *cut), (*cut, len(rows)), strict=True):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        events = evidence(live.event_stream(spark, source, SCHEMA))
        live.replay_into(events, path, checkpoint, 90, availableNow=True).awaitTermination(300)
    got = spark.read.parquet(path)
    assert got.select(F.max("batch")).first()[0] == 2
    assert found(got) == walked(rows, 90)


@pytest.mark.parametrize("cut", [(30, 31, 90)])
def test_keyed_state_equals_a_walk(spark, tmp_path, cut):
    """Each micro-batch is a query that starts anew from its checkpoint."""
    rows = made(120)
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", verdicts.PROVIDER)
    try:
        for a, b in zip((0, *cut), (*cut, len(rows)), strict=True):
            spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(source)
            events = evidence(live.event_stream(spark, source, SCHEMA))
            assert verdicts.judge_into(events, path, checkpoint, 90, availableNow=True).awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.parquet(path)
    assert found(got) == walked(rows, 90)
    assert {(r.id, r.ts, r.domain) for r in got.collect()} == {(r[0], r[1], r[2]) for r in rows}


def test_missing_answers_count_by_share(spark):
    """From five observations on, half of them missing is a finding, however few that are."""
    rows = [(4, 2), (5, 2), (5, 3), (6, 3), (8, 4), (8, 3)]
    df = spark.createDataFrame([(t, m, 1, 0) for t, m in rows], "total int, nxdomain int, distinct_names int, blocked int")
    got = {(r.total, r.nxdomain): r.behavioral.score for r in scorers.behavioral(df).collect()}
    assert got == {(4, 2): 0, (5, 2): 0, (5, 3): 22, (6, 3): 22, (8, 4): 22, (8, 3): 0}


def test_short_verdicts_equal_the_assessment(spark):
    """``fusion.blocks`` decides as ``assess`` does, on signals of all kinds."""
    import random

    rng = random.Random(8)
    codes = {"lexical": ["BRAND_IMPERSONATION", "SUSPICIOUS_TLD", "LENGTH_LONG", "PUNYCODE"], "dga": ["DGA_HIGH"], "tunnel": ["DNS_TUNNEL_INDICATORS"], "ti": ["TI"], "behavioral": ["B"]}

    def signal(name):
        if rng.random() < 0.2:
            return None
        factors = [(c, "low", float(rng.choice([0, 10, 30]))) for c in codes[name] if rng.random() < 0.6]
        scope = {"ti": None, "behavioral": None}.get(name, rng.choice(["registrant_label", "delegated_span", "controlled_span"]))
        return (name, float(rng.choice([0, 25, 60, 70, 95])), rng.choice([0.0, 0.35, 0.85, 0.95]), scope, rng.choice(["MALICIOUS", "TRUSTED", "UNKNOWN"]) if name == "ti" else "SCORED", factors)

    rows = []
    for _ in range(600):
        total, names, missing, blocked = rng.randint(0, 40), rng.randint(0, 12), rng.randint(0, 20), rng.randint(0, 6)
        rows.append((*(signal(n) for n in replay.EVIDENCE), total, names, missing, blocked))
    df = spark.createDataFrame(rows, ", ".join(f"{n} {scorers.SIGNAL}" for n in replay.EVIDENCE) + ", total int, distinct_names int, nxdomain int, blocked int")
    out = fusion.assess(scorers.behavioral(df)).select("assessment.decision", "behavioral.score", "behavioral.confidence", "total", "distinct_names", "nxdomain", "blocked", *fusion.terms()).collect()
    blocked = 0
    for r in out:
        own = scorers.behaved(r.total, r.distinct_names, r.nxdomain, r.blocked)
        assert own == (r.score, pytest.approx(r.confidence))
        assert fusion.blocks(r, *own) == (r.decision == "BLOCK")
        blocked += r.decision == "BLOCK"
    assert 100 < blocked < 500


def test_a_busy_domain_in_many_slices(spark):
    """Chains of verdicts that go on from slice to slice."""
    rows = [(i, START + datetime.timedelta(minutes=i), f"h{i % 4}.busy.test", "busy.test", "dns", "NXDOMAIN" if i % 3 else "NOERROR", 66 + i % 6, "x") for i in range(400)]
    got = found(replay.replay(evidence(spark.createDataFrame(rows, SCHEMA)), 20))
    assert got == walked(rows, 20) and 0 < sum(b for _, _, b in got.values()) < 400

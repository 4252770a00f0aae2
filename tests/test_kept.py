"""Tables kept by streams against batch results after every micro-batch, and windows against plain loops."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tidewarden.plans import dashboards
from tidewarden.streaming import kept, live, sliding

START = datetime.datetime(2024, 5, 1)
SCHEMA = (
    "id long, ts timestamp, domain string, registrable_domain string, event_type string, risk_score int, classification string, decision string, query_type string, client_address string, blocked boolean, "
    "cache_hit boolean, upstream_used boolean, response_code string, analysis_time_ms double, "
    "top_factors array<struct<code:string,severity:string,contribution:double>>, block_policy string"
)


def made(a, b):
    out = []
    for i in range(a, b):
        risk, dns = (i * 37) % 100, i % 5 != 0
        kind = "SAFE" if risk < 30 else "SUSPICIOUS" if risk < 70 else "MALICIOUS"
        decision = {"SAFE": "ALLOW", "SUSPICIOUS": "MONITOR", "MALICIOUS": "BLOCK"}[kind]
        out.append((
            i, START + datetime.timedelta(minutes=(i * 17) % 300), f"h{i % 23}.d{i % 4}.test", None if i % 29 == 0 else f"d{i % 4}.test", "dns" if dns else "analysis", risk, kind, decision, ["A", "TXT", "MX"][i % 3],
            None if i % 7 == 0 else f"10.0.0.{i % 6}", decision == "BLOCK" and dns, i % 4 == 1, i % 4 == 2, "NXDOMAIN" if i % 3 else None, i / 7, [("DGA_HIGH", "high", 1.0)] * (i % 2), "REFUSED" if i % 3 else None,
        ))
    return out


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_kept_dashboards_equal_the_batch_after_every_micro_batch(spark, tmp_path):
    source, path, every = str(tmp_path / "in"), str(tmp_path / "kept"), 2
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    assert kept.current(spark, f"{path}/domains", ["domain"]) is None
    for a, b in ((0, 150), (150, 151), (151, 400), (400, 620), (620, 700)):
        spark.createDataFrame(made(a, b), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        for q in kept.keep_dashboards(live.event_stream(spark, source, SCHEMA), path, every, availableNow=True):
            assert q.awaitTermination(200)
        batch = spark.createDataFrame(made(0, b), SCHEMA)
        now = {n: kept.current(spark, f"{path}/{n}", keys) for n, keys in kept.TABLES.items()}
        assert rows(kept.dashboard(now["domains"], "top_risky")) == rows(dashboards.top_risky(batch))
        assert rows(kept.dashboard(now["domains"], "top_blocked", 5)) == rows(dashboards.top_blocked(batch, 5))
        assert rows(kept.dashboard(now["clients"], "sources")) == rows(dashboards.source_stats(batch))
        hours = dashboards.hourly(batch.where("event_type = 'dns'"), "decision", ["ALLOW", "MONITOR", "BLOCK"], START + datetime.timedelta(hours=10))
        assert rows(kept.dashboard(now["hours"], "activity")) == rows(hours)
        rate = kept.dashboard(now["measures"], "rates").first()
        assert (rate.events, rate.hit_rate) == (b, round(sum(r[11] for r in made(0, b)) / sum(r[11] or r[12] for r in made(0, b)), 3))
    assert len(list((tmp_path / "kept/domains/changes").iterdir())) < 5  # snapshots took the place of the first changes
    with pytest.raises(ValueError):
        kept.dashboard(now["hours"], "other")


def test_a_micro_batch_that_runs_again_counts_once(spark, tmp_path):
    path = str(tmp_path)
    for n, rows_ in ((0, [("a", 1), ("b", 1)]), (1, [("a", 2)]), (1, [("a", 5)])):
        spark.createDataFrame(rows_, "k string, n int").write.mode("overwrite").parquet(f"{path}/changes/batch={n}")
    assert {(r.k, r.n) for r in kept.current(spark, path, ["k"]).collect()} == {("a", 5), ("b", 1)}
    assert {(r.k, r.n) for r in kept.current(spark, path, ["k"], 0).collect()} == {("a", 1), ("b", 1)}


def test_counters_over_time(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "counters")
    for a, b in ((0, 100), (100, 130)):
        spark.createDataFrame(made(a, b), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    listener = kept.CounterListener(spark, path)
    spark.streams.addListener(listener)
    try:
        stream = live.counters(live.event_stream(spark, source, SCHEMA, files=1))
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(200)
        for _ in range(100):
            if (tmp_path / "counters").exists() and kept.counted(spark, path).count() >= 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = kept.counted(spark, path).orderBy("batch").collect()
    assert sum(r.queries for r in got) == 130 and sum(r.cache_hits for r in got) == sum(r[11] for r in made(0, 130))
    assert got[-1].hit_rate_so_far == round(sum(r[11] for r in made(0, 130)) / sum(r[11] or r[12] for r in made(0, 130)), 3)


def by_loop(events, window, step):
    out = {}
    for t in range(0, 2000, step):
        end = START + datetime.timedelta(minutes=t)
        for key in {e[3] for e in events} - {None}:
            seen = [e for e in events if e[3] == key and end - datetime.timedelta(minutes=window) <= e[1] < end]
            if seen:
                out[key, end] = (len(seen), len({e[2] for e in seen}), max(e[5] for e in seen), sum(e[10] for e in seen), sum(e[13] == "NXDOMAIN" and not e[10] for e in seen))
    return out


@pytest.mark.parametrize(("pane", "window", "step"), [(5, 60, 15), (10, 30, 30), (1, 7, 1)])
def test_windows_equal_a_loop(spark, pane, window, step):
    events = made(0, 200)
    df = spark.createDataFrame(events, SCHEMA)
    want = by_loop(events, window, step)
    got = sliding.windows(sliding.panes(df, pane), pane, window, step).collect()
    assert {(r.registrable_domain, r.end): (r.events, r.distinct_names, r.max_risk, r.blocked, r.nxdomain) for r in got} == want
    exact = {(r.registrable_domain, r.end): (r.events, r.distinct_names) for r in sliding.exact_windows(df, window, step).collect()}
    assert exact and all(want[k][:2] == v for k, v in exact.items())
    for k in set(want) - set(exact):  # nothing changed there: as in the window before
        assert want[k][:2] == want[k[0], k[1] - datetime.timedelta(minutes=step)][:2]


def test_merged_sketches_are_near(spark):
    df = spark.range(40_000).select(F.lit("d.test").alias("registrable_domain"), F.concat(F.lit("h"), F.col("id") % 20_000).alias("domain"), F.timestamp_seconds(1_714_521_600 + F.col("id") % 3600).alias("ts"), F.lit(1).alias("risk_score"), F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("response_code"))
    r = sliding.windows(sliding.panes(df, 1), 1, 60, 60).where("events = 40000").first()
    assert abs(r.distinct_names / 20_000 - 1) < 4 * sliding.RELATIVE_ERROR
    with pytest.raises(ValueError):
        sliding.windows(sliding.panes(df, 7), 7, 60, 60)

"""Queries against their SQL on the smallest tables, and what the SQL can't reach."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewarden.operators import history, training
from tidewarden.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "events pages part customer nation documents".split()
NAMES = "name_errors name_kinds brand_matches lexical_scores tunnel_scores dga_scores assessed_hosts capture_totals gateway_outcomes stored_events zeek_queries pcap_questions stream_hourly trailing_behaviour timing_percentiles family_separation sql_functions replayed_verdicts generated_names".split()
NAMES += "suffix_split lexicon_coverage capture_ranges answer_records answer_lifetimes upload_totals upload_sources sliding_exact sliding_panes kept_sources kept_top_blocked kept_rates stored_model fused_detectors".split()
NAMES += "evolved_events event_projection shown_features url_errors listed_hosts stream_verdicts client_behaviour top_blocked_domains".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(SF, "events.parquet").exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    expected = duck.execute(catalog.ORACLE_SQL[name])
    columns = sorted(c[0] for c in expected.description)
    assert sorted(found.columns) == columns
    place = [[c[0] for c in expected.description].index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in place] for r in expected.fetchall()), key=str)
    assert sorted(([plain(r[c]) for c in columns] for r in found.collect()), key=str) == want


def test_trailing_history_against_a_loop(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=(i * i * 7) % 400, seconds=i % 2), "d" + str(i % 2), f"n{i % 3}", i % 90, "dns" if i % 4 else "analysis", i % 5 == 0, "NXDOMAIN" if i % 3 else None) for i in range(120)]
    events = spark.createDataFrame(rows, "id int, ts timestamp_ntz, registrable_domain string, domain string, risk_score int, event_type string, blocked boolean, response_code string")
    for r in history.trailing(events, 60).collect():
        past = [x for x in rows if x[2] == r.registrable_domain and r.ts - datetime.timedelta(minutes=60) <= x[1] < r.ts]
        want = (
            sum(x[5] == "dns" for x in past) + len({x[3] for x in past if x[5] != "dns"}), len({x[3] for x in past}), max((x[4] for x in past), default=0),
            sum(x[6] for x in past), sum(x[7] == "NXDOMAIN" and not x[6] for x in past),
        )
        assert (r.total, r.distinct_names, r.max_risk, r.blocked_before, r.nxdomain) == want


def test_each_row_of_the_letter_grid_sums_to_one(spark):
    table = training.log_probabilities(training.pair_counts(spark.createDataFrame([("mill",), ("mole7",), ("",), (None,)], "label string")))
    assert all(abs(r.p - 1) < 1e-9 for r in table.groupBy("prev").agg(F.sum(F.exp("log_prob")).alias("p")).collect())

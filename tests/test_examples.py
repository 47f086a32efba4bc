"""Hand-checked cases of the operators, apart from the SQL comparison."""

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import clock, geo, text
from tidewheel.operators import rolling as R
from tidewheel.operators import rules as Q
from tidewheel.plans.people import nowcast
from tidewheel.sources import files as S

T0 = 1_700_000_400 // 1200 * 1200


def test_censored_counts_equal_the_definition(spark):
    rows = [("A", 0, 10), ("A", 5, 50), ("A", 30, None), ("B", 7, 300), ("B", 20, 21), ("B", 20, 40), ("A", 59, 119)]
    trips = spark.createDataFrame([(s, T0 + a * 60, None if z is None else T0 + z * 60) for s, a, z in rows], "station_id string, start_s long, end_s long")
    for window, embargo, tick in ((60, 30, 5), (60, 0, 5), (5, 0, 5)):
        steps = R.censored_counts(trips, window * 60, embargo * 60, tick * 60)
        ticks = [T0 + k * tick * 60 for k in range(-3, 480 // tick)]
        wanted = spark.createDataFrame([(s, t) for s in "ABC" for t in ticks], "station_id string, tick long")
        for r in R.as_of(steps, wanted).collect():
            t = r.tick
            want = sum(s == r.station_id and z is not None and T0 + z * 60 <= t and t - (embargo + window) * 60 <= T0 + a * 60 < t - embargo * 60 for s, a, z in rows)
            assert r["count"] == want, (r, window, embargo)


def test_lag_over_a_gap_is_null(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 3600, 6), (1, 10800, 7)], "station_id long, tick long, v long")
    got = {r.tick: r.lag for r in R.exact_lag(df, "v", 3600, "lag").collect()}
    assert got == {0: None, 3600: 5, 10800: None}


def test_forward_fill_staleness(spark):
    df = spark.createDataFrame([("g", 1200, 1.0), ("g", 4800, 2.0)], "k string, t long, v double")
    got = {r.tick: r.v for r in R.forward_fill(df, 1200, 3600, "k", "t", ["v"]).collect()}
    assert got == {1200: 1.0, 2400: 1.0, 3600: 1.0, 4800: 2.0, 6000: 2.0, 7200: 2.0, 8400: 2.0}


def test_nowcast_examples(spark):
    def run(values):
        actual = spark.createDataFrame([("c", 700 - 7 * week, v) for week, v in values.items()], "cell string, day long, v double")
        return nowcast(actual, 700, 701, ["cell"], "v").first()

    r = run({1: 100.0, 2: 200.0, 3: 300.0, 4: 400.0})
    assert (r.estimate, r.method) == (pytest.approx(200.0), "weighted_avg")
    r = run({1: 100.0, 3: 300.0, 4: 400.0})
    assert (r.estimate, r.method) == (pytest.approx(200.0), "reweighted_avg")
    r = run({6: 250.0, 8: 1.0})
    assert (r.estimate, r.method) == (250.0, "extended_lookback_fallback")


def test_type_errors_become_null_whatever_the_fill(spark):
    rules = [{"name": "q", "types": ["int"], "on_outlier": "fill_zero", "on_missing": "fill_zero"}]
    df = spark.createDataFrame([(1, "7"), (2, "bad"), (3, None), (4, "")], "k long, q string")
    got = {r.k: (r.q, r._row_status) for r in Q.validate(df, rules).collect()}
    assert got == {1: (7, "ok"), 2: (None, "repaired"), 3: (0, "repaired"), 4: (0, "repaired")}


def test_text_functions(spark):
    df = spark.createDataFrame([("none",), ("under 1mm",), ("30.0~50.0mm",), ("2.5mm",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(text.precipitation(F.col("t"))).collect()] == [0.0, 0.5, 30.0, 2.5, None, None]


def test_lambert_cell_of_a_known_city(spark):
    nx, ny = geo.lambert_cell(F.lit(37.5665), F.lit(126.978))
    r = spark.range(1).select(nx.alias("x"), ny.alias("y")).first()
    assert (r.x, r.y) == (60, 127)


def test_calendar(spark):
    s = F.lit(946684800)  # Saturday, 2000-01-01
    r = spark.range(1).select(clock.weekday(s).alias("w"), clock.day_index(s).alias("d"), clock.minute_of_day(s + 90).alias("m")).first()
    assert (r.w, r.d, r.m) == (5, 0, 1)


def test_upsert_and_reconcile(spark):
    cur = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "c")], "k long, g long, v string")
    inc = spark.createDataFrame([(1, 9, "x"), (2, 20, "y"), (4, 1, "z")], "k long, g long, v string")
    got = {r.k: (r.v, r._change) for r in S.upsert(cur, inc, ["k"], "g").collect()}
    assert got == {1: ("a", "older"), 2: ("y", "update"), 3: ("c", "keep"), 4: ("z", "insert")}
    got = {r.k: (r.g, r._change) for r in S.reconcile(cur, inc, ["k"], "g").collect()}
    assert got == {1: (10, "update"), 2: (20, "update"), 3: (30, "delete"), 4: (1, "insert")}


def test_schema_guards(spark):
    df = spark.createDataFrame([(1.5,), (2.0,), (None,)], "v double")
    assert S.lossy(df, {"v": "int"}).count() == 1
    assert S.conform(df, {"v": "int", "w": "string"}).columns == ["v", "w"]
    with pytest.raises(ValueError):
        S.require_groups(df, [["a", "b"]])

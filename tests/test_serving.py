"""Serving health, forecasts and routes case by case; gates, panels and loads on small tables."""

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import clock
from tidewheel.operators import rolling, rules, serving
from tidewheel.plans import sets
from tidewheel.sources import files, incremental

NOW = 100 * 86400


def health(spark, weather=(24, 24, True, NOW - 60), **changed):
    at = dict.fromkeys(serving.KEYS, (NOW, 5)) | {k.replace("__", ":"): v for k, v in changed.items()}
    states = spark.createDataFrame([(NOW, k, *v) for k, v in at.items() if v] + [(NOW, "unheard_of", NOW, 1)], "now long, key string, logical_s long, n long")
    w = spark.createDataFrame([(NOW, *weather)] if weather else [], "now long, n long, expected long, fresh boolean, oldest_s long")
    got = serving.health(spark.createDataFrame([(NOW,)], "now long"), states, w).collect()
    assert len(got) == 7
    return {r.component: r for r in got}, got[0].overall, got[0].can_dispatch


def test_all_ready(spark):
    parts, overall, can = health(spark)
    assert overall == "healthy" and can and {r.state for r in parts.values()} == {"ready"}
    assert parts["weather"].age_min == 1.0


@pytest.mark.parametrize(
    ("changed", "component", "state", "reason", "overall"),
    [
        ({"station_stock": None}, "stock", "missing", "not_published", "unavailable"),
        ({"station": None}, "stock", "missing", "not_published", "unavailable"),
        ({"station": (NOW - 300, 1)}, "stock", "misaligned", "station_stock_anchor_mismatch", "degraded"),
        ({"station_stock": (NOW - 4000, 1)}, "stock", "expired", "publication_expired", "unavailable"),
        ({"station_demand_forecast": (NOW - 700, 1)}, "demand", "stale", "publication_stale", "degraded"),
        ({"station_demand_forecast": (NOW - 3601, 1)}, "demand", "expired", "publication_expired", "unavailable"),
        ({"station_urgency": (NOW - 300, 1)}, "stock", "misaligned", "operational_anchor_mismatch", "degraded"),
        ({"rebalance_route": (NOW + 301, 1)}, "routes", "stale", "publication_stale", "degraded"),
        ({"weather_forecast": (NOW - 900, 1)}, "weather", "stale", "publication_stale", "degraded"),
        ({"event__cultural_event": None}, "events", "missing", "event_source_incomplete", "degraded"),
        ({"event__performance_event": (NOW - 130000, 1)}, "events", "stale", "event_source_incomplete", "degraded"),
        ({"event__cultural_event": None, "event__performance_event": None}, "events", "missing", "not_published", "degraded"),
        ({"dispatch_center": (NOW, 0)}, "regions", "missing", "not_published", "degraded"),
    ],
)
def test_one_thing_is_wrong(spark, changed, component, state, reason, overall):
    parts, found, can = health(spark, **changed)
    assert (parts[component].state, parts[component].reason, found) == (state, reason, overall)
    assert can == (component in ("weather", "events", "regions"))


@pytest.mark.parametrize(("weather", "state"), [((23, 24, True, NOW), "misaligned"), ((24, 24, False, NOW), "stale"), (None, "misaligned")])
def test_weather_rows_decide(spark, weather, state):
    assert health(spark, weather)[0]["weather"].state == state


def test_forecast_states(spark):
    hours = lambda i, base=NOW, n=12, step=3600: [(i, base, base + k * step, 1.0, 2.0) for k in range(1, n + 1)]
    panel = hours(1) + hours(2, n=11) + hours(3) + hours(4) + hours(9) + [(5, NOW, NOW + 3600, 0.0, 0.0)] * 12
    stations = [(i, NOW if i != 4 else NOW - 300, i != 8) for i in (1, 2, 3, 4, 5, 6, 8)]
    stock = [(i, NOW if i != 3 else NOW - 300, 7) for i in (1, 2, 3, 4, 5, 6)]
    frames = lambda p: (spark.createDataFrame(stations, "station_id long, seen_s long, active boolean"), spark.createDataFrame(p, "station_id long, base_s long, target_s long, rent double, ret double"), spark.createDataFrame(stock, "station_id long, base_s long, bikes long"))
    got = {r.station_id: r for r in serving.forecast_states(*frames(panel), NOW).collect()}
    assert {i: r.state for i, r in got.items()} == {1: "ready", 2: "forecast_not_ready", 3: "stock_not_aligned", 4: "stock_not_aligned", 5: "forecast_not_ready", 6: "forecast_not_available", 9: "station_not_found"}
    assert [p.target_s for p in got[1].points] == [NOW + k * 3600 for k in range(1, 13)] and got[2].points is None
    mixed = {r.state for r in serving.forecast_states(*frames(panel + hours(1, NOW - 300)), NOW).collect()}
    assert mixed == {"forecast_not_ready", "station_not_found"}
    assert {r.state for r in serving.forecast_states(*frames(panel), NOW + 700).collect()} == {"forecast_not_ready", "station_not_found"}
    here = serving.station_rows(frames(panel)[0], frames(panel)[2], NOW)
    assert sorted(r.station_id for r in here.collect()) == [1, 2, 5, 6]
    assert serving.station_rows(frames(panel)[0], frames(panel)[2], NOW + 601).count() == 0
    assert serving.station_rows(frames(panel)[0], frames(panel)[2], NOW + 601, allow_stale=True).count() == 4


def test_routes(spark):
    routes = [(1, 7, "proposed", 50, None), (2, 7, "proposed", 50, None), (3, 7, "proposed", 50, None), (4, 7, "dispatched", 50, 86400 + 9), (5, 7, "completed", 50, 86400 + 8), (6, 7, "completed", 50, 2 * 86400)]
    stops = [(1, 2, 30, "dropoff", 4), (1, 1, 10, "pickup", 4), (2, 1, 31, "dropoff", 1), (2, 2, 30, "dropoff", 1), (3, 1, 32, "dropoff", 1)]
    score = [(30, 50, 5.0), (31, 50, 9.0), (32, 49, 99.0)]
    got = serving.route_rows(spark.createDataFrame(routes, "route_id long, center_id long, status string, proposed_s long, dispatched_s long"), spark.createDataFrame(stops, "route_id long, visit long, station_id long, action string, bikes long"), spark.createDataFrame(score, "station_id long, base_s long, score double"))
    rows = {r.route_id: r for r in got.collect()}
    assert {i: (r.work_no, r.priority, r.anchor) for i, r in rows.items()} == {1: (None, 2, 30), 2: (None, 1, 31), 3: (None, None, 32), 4: (2, None, None), 5: (1, None, None), 6: (1, None, None)}
    assert [s.visit for s in rows[1].stops] == [1, 2] and rows[4].stops == []


def test_batch_gates(spark):
    rows = spark.createDataFrame([("ok",)] * 8 + [("repaired",), ("dropped",)], "_row_status string")
    gate = lambda planned, missing, got, **more: rules.gates(rows, plan=spark.createDataFrame([(planned, missing, got)], "planned long, parts_missing long, parts_got long"), **more).first()
    assert gate(10, 0, 1)["pass"] and gate(11, 0, 1)["pass"]
    assert not gate(12, 0, 1)["pass"] and gate(12, 0, 1).missing_ratio == pytest.approx(0.166667)
    assert not gate(9, 0, 1)["pass"] and gate(9, 0, 1).over_ratio == pytest.approx(0.111111)
    assert not gate(None, 1, 4)["pass"] and gate(None, 1, 9)["pass"] and gate(None, 0, 0)["pass"]
    assert gate(0, 5, 5).missing_ratio == 0 and not gate(10, 0, 1, max_drop=0.05)["pass"]


def test_panel_gaps(spark):
    whole = [(s, h, 5) for s in (1, 2) for h in range(1, 13)]
    stations = spark.createDataFrame([(1,), (2,), (3,)], "station_id long")
    gaps = lambda rows: {r.station_id: tuple(r)[1:] for r in rules.panel_gaps(spark.createDataFrame(rows, "station_id long, horizon long, base_s long"), stations).collect()}
    assert gaps(whole) == {1: (0, 0, 0, 0), 2: (0, 0, 0, 0), 3: (12, 0, 0, 0)}
    assert gaps([*whole[1:], (1, 2, 5), (1, 13, 5), (9, 1, 4), (2, 3, None)]) == {1: (1, 1, 1, 0), 2: (0, 0, 1, 1), 3: (12, 0, 0, 0), 9: (0, 1, 0, 1)}


def test_one_pass_counts_equal_the_single_ones(spark, sf):
    from tidewheel.plans.base import trips

    t = trips(spark, sf)
    back = t.where("end_s is not null").select("event_id", F.col("end_station_id").alias("station_id"), F.col("end_s").alias("start_s"))
    steps = rolling.count_steps(t)
    for fn, want in (("rental", rolling.future_counts(t)), ("returned", rolling.future_counts(back)), ("recent", rolling.censored_counts(t))):
        got = steps.where(F.col("fn") == fn).select("station_id", "tick", "count")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_slots(spark):
    at = lambda h, m: h * 3600 + m * 60 + 86400
    rows = [(at(14, 39), "hourly", at(13, 0)), (at(14, 40), "hourly", at(14, 0)), (at(14, 20), "half_hourly", at(13, 30)), (at(14, 30), "half_hourly", at(14, 30)), (at(2, 5), "three_hourly", at(-1, 0)), (at(2, 10), "three_hourly", at(2, 0)), (at(14, 59), "three_hourly", at(14, 0)), (at(14, 9), "three_hourly", at(11, 0)), (at(14, 39), "ten_minutely", at(14, 30)), (at(14, 39), "thirty_minutely", at(14, 30))]
    for s, kind, want in rows:
        assert spark.range(1).select(clock.publication_slot(F.lit(s), kind)).first()[0] == want, (s, kind)


def test_pages_do_not_overlap(spark):
    routes = spark.createDataFrame([(i, i % 3, "open" if i % 2 else "closed", i // 4, None if i % 2 else i) for i in range(40)], "route_id long, region long, status string, proposed long, closed long")
    ids = lambda **k: [r.route_id for r in sets.paged(routes, **k).collect()]
    assert ids(limit=40) == ids(limit=15) + ids(limit=15, offset=15) + ids(limit=15, offset=30)
    assert set(ids(limit=40, status=("closed",), closed_since=20, region=2)) == {i for i in range(20, 40, 2) if i % 3 == 2}
    assert set(ids(limit=40, closed_since=20)) == {i for i in range(40) if i % 2 or i >= 20}


def test_archive_is_loaded_again_to_the_same_table(spark):
    path, day = files.work_folder(spark, "load"), 86400
    rows = [(1, day + 10, 1), (1, day + 10, 1), (2, day + 7200, 1), (3, 2 * day, 1), (-4, day, 1), (5, 2 * day, 2), (None, 2 * day, 2)]
    df = spark.createDataFrame(rows, "id long, s long, file_day long")
    load = lambda part: [tuple(r) for r in incremental.load_archive(part, path, ["id", "s"], F.col("id") > 0).orderBy("day").collect()]
    assert load(df) == [(1, 5, 1, 1, 1, 2, 2), (2, 2, 1, 0, 0, 1, 1)]
    assert load(df.where("file_day = 1")) == [(1, 5, 1, 1, 1, 2, 2)]
    assert spark.read.parquet(path).count() == 3


def test_retention(spark):
    k = lambda *v: spark.createDataFrame([(x,) for x in v], "key string")
    listing = spark.createDataFrame([(x, s) for x, s in (("a", 0), ("b", 0), ("c", 0), ("d", 69 * 86400 + 1), ("e", 69 * 86400))], "key string, modified_s long")
    got = {r.key: r.verdict for r in incremental.retention(listing, k("b", "c", "d", "e", "e", "gone"), k("a", "b"), 99 * 86400).collect()}
    assert got == {"a": "unknown", "b": "authority", "c": "candidate", "d": "recent", "e": "candidate"}


def test_late_rows_mark_their_days(spark):
    path = files.work_folder(spark, "marked")
    rows = spark.createDataFrame([(1, d, (d + 6) * 86400) for d in range(10)] + [(2, 3, 20 * 86400), (3, 1, 60 * 86400)], "id long, day long, arrival long")
    counted = lambda r: r.groupBy("day").agg(F.count("*").alias("n"))
    marks = lambda now: {r.day: r.state for r in incremental.recompute_days(spark, path, rows, counted, now * 86400).collect()}
    table = lambda: {r.day: r.n for r in spark.read.parquet(path).collect()}
    assert set(marks(10)) == set(range(5)) and table() == dict.fromkeys(range(5), 1)
    assert set(marks(20)) == {3, *range(5, 10)} and table() == dict.fromkeys(range(10), 1) | {3: 2}
    assert marks(30) == {}
    assert marks(60) == {1: "out_of_reach"} and table()[1] == 1
    spread = incremental.dirty_days(rows, 19 * 86400, 20 * 86400, spill=2)
    assert sorted(r.day for r in spread.collect()) == [3, 4, 5]

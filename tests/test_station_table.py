"""The station projection case by case."""

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import replay, station_table
from tidewheel.plans import composites

HERE = (37.5, 127.0)
NEAR = (37.5005, 127.0)  # 56 m
FAR = (37.51, 127.0)  # 1.1 km


def project(spark, master=(), windows=(), previous=(), ready=(), approvals=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = station_table.project(
        frame(master, "station_id long, address string, lat double, lon double"),
        frame(windows, "station_id long, no int, name string, capacity long, lat double, lon double, seen_s long"),
        frame(previous, "station_id long, name string, address string, capacity long, lat double, lon double, source string, base_s long, seen_s long, active boolean"),
        frame(((r,) for r in ready), "station_id long"),
        frame(approvals, "station_id long, comparison string, lat double, lon double"),
        500,
    )
    return {r.station_id: r for r in out.collect()}


def old(i=1, active=True, at=HERE):
    return (i, "old", "road", 10, *at, "master", 100, 90, active)


def seen(no, i=1, name="new", capacity=12, at=HERE):
    return (i, no, name, capacity, *at, 1000 - no)


MASTER = [(1, "street", *HERE)]


@pytest.mark.parametrize(("valid", "active"), [([1], True), ([2], True), ([3], True), ([], False)])
def test_one_two_and_three_invalid_windows(spark, valid, active):
    """The first valid window ends the run of invalid ones; the newest of three decides nothing alone."""
    windows = [seen(no, name="new" if no in valid else " ") for no in (1, 2, 3)]
    got = project(spark, MASTER, windows, [old()])[1]
    assert got.active == active
    assert (got.name, got.capacity) == (("new", 12) if valid == [1] else ("old", 10))
    assert got.change == ("update" if active else "deactivate")


def test_absent_windows_count_as_invalid(spark):
    other = [seen(no, 2) for no in (1, 2, 3)]
    assert not project(spark, MASTER, other, [old()])[1].active
    assert project(spark, MASTER, [*other, seen(3)], [old()])[1].active
    got = project(spark, MASTER, other, [old()])[1]
    assert got.seen_s == 90 and got.base_s == 500


def test_a_closed_station_opens_when_it_is_ready(spark):
    assert not project(spark, MASTER, [seen(1)], [old(active=False)])[1].active
    got = project(spark, MASTER, [seen(1)], [old(active=False)], ready=[1])[1]
    assert got.active and got.change == "activate"
    assert not project(spark, MASTER, [seen(1, name=None)], [old(active=False)], ready=[1])[1].active


def test_new_stations(spark):
    got = project(spark, [(1, "street", *HERE), (2, "lane", None, None), (3, None, *HERE), (4, "way", None, None)], [seen(1, 1), seen(1, 2), seen(1, 3), seen(1, 4, at=(None, 127.0)), seen(1, 5), seen(2, 6)], ready=[2])
    assert set(got) == {1, 2}  # no address, no place, no master row, no valid newest window: not yet
    assert got[1].source == "master" and got[2].source == "realtime" and got[1].change == "insert"
    assert not got[1].active and got[2].active


def test_moves_beyond_100_metres_need_approval(spark):
    assert project(spark, [(1, "street", *NEAR)], [seen(1)], [old()])[1].lat == NEAR[0]
    far = [(1, "street", *FAR)]
    kept = project(spark, far, [seen(1, at=FAR)], [old()])[1]
    assert (kept.lat, kept.address, kept.kept, kept.base_s) == (HERE[0], "road", True, 100)
    moved = project(spark, far, [seen(1, at=FAR)], [old()], approvals=[(1, "previous", *FAR)])[1]
    assert (moved.lat, moved.change, moved.used, moved.base_s) == (FAR[0], "move", ["previous"], 500)
    assert project(spark, far, [seen(1, at=HERE)], [old()], approvals=[(1, "previous", *FAR)])[1].kept  # the window disagrees too
    both = [(1, "previous", *FAR), (1, "realtime", *FAR)]
    assert sorted(project(spark, far, [seen(1, at=HERE)], [old()], approvals=both)[1].used) == ["previous", "realtime"]
    assert project(spark, far, [seen(1, at=FAR)], [old()], approvals=[(1, "previous", *NEAR)])[1].kept  # approved for another place


def test_spare_approvals_raise(spark):
    master, windows, previous, ready, approvals = composites.station_inputs(spark, "/root/testdata/sf0.001")
    out = station_table.project(master, windows, previous, ready, approvals, 1)
    with pytest.raises(ValueError, match="nothing needed"):
        station_table.require_all_used(out, approvals)
    used = out.select("station_id", F.explode("used").alias("comparison"))
    station_table.require_all_used(out, approvals.join(used, ["station_id", "comparison"], "left_semi"))


def test_mapping_gate(spark):
    master = spark.createDataFrame([(i, 10, 37.5, 127.0) for i in range(19)] + [(50, 10, 33.0, 126.0), (51, 10, None, 126.0)], "station_id long, capacity long, lat double, lon double")
    live = spark.createDataFrame([(0, 99, None, 127.0), (1, None, 37.6, 127.1)], "station_id long, capacity long, lat double, lon double")
    cells = spark.createDataFrame([(37.5, 127.0), (37.6, 127.1)], "lat double, lon double").select(station_table.weather_cell(F.col("lat"), F.col("lon")).alias("weather_cell"))
    got = {r.station_id: r for r in station_table.enrich(master, live, cells).collect()}
    assert (got[0].capacity, got[0].place_source) == (99, "master")
    assert (got[1].capacity, got[1].place_source, got[1].lat) == (10, "live", 37.6)
    assert got[50].weather_cell is None and got[51].place_source is None
    with pytest.raises(ValueError, match="19 of 20"):
        station_table.enrich(master, live, cells, 0.96)


def test_replay_of_one_station(spark):
    checks = spark.createDataFrame([(1, 0, 2), (1, 100, 5), (1, 200, 5)], "station_id long, t long, bikes long")
    moves = spark.createDataFrame([(1, 10, -1), (1, 20, -1), (1, 90, 1), (1, 150, -1), (1, 200, 1), (1, 0, -1), (1, 300, 1)], "station_id long, t long, delta long")
    assert [tuple(r) for r in replay.unexplained(checks, moves).orderBy("t0").collect()] == [(1, 0, 100, 4), (1, 100, 200, 0)]
    got = {r.timing: tuple(r)[2:] for r in replay.replay_timings(checks, moves).collect()}
    assert got == {"interval_start": (0, 0, 2, 0), "interval_midpoint": (30, 0, 0, 0), "interval_end": (70, 0, 0, 0)}
    assert {r.timing: r.end_error for r in replay.replay_timings(checks, moves, least=5).collect()} == dict.fromkeys(replay.TIMINGS, 4)

"""Operators that SQL does not express, against brute force, and the edges of those that it does."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidewheel.plans import models, people, sets, space
from tidewheel.plans.base import stations
from tidewheel.sources import files


def test_hash_shard(spark, sf):
    rows, users = Counter(), defaultdict(set)
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id").collect():
        shard = zlib.crc32(str(r.user_id).encode()) % 16
        rows[shard] += 1
        users[shard].add(r.user_id)
    got = __spark_entry__.queries()["p27_hash_shard"](spark, sf).collect()
    assert {r.shard: (r.n, r.users) for r in got} == {k: (n, len(users[k])) for k, n in rows.items()}


def clipped_area(ring, x0, y0, side):
    for axis, bound, sign in ((0, x0, 1), (0, x0 + side, -1), (1, y0, 1), (1, y0 + side, -1)):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            a, b = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if a >= 0:
                out.append(p)
            if (a >= 0) != (b >= 0):
                t = a / (a - b)
                out.append(tuple(u + t * (v - u) for u, v in zip(p, q)))
        ring = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2


def test_cell_overlap_area(spark, sf):
    """Every cell with a station against every area: exactly the pairs that overlap come back."""
    rings = dict(space.AREAS)
    got = {(r.r, r.c, r.area): r.overlap for r in __spark_entry__.queries()["j13_cell_overlap_area"](spark, sf).collect()}
    cells = {(math.floor(s.lat / 0.01), math.floor(s.lon / 0.01)) for s in stations(spark, sf).collect()}
    want = {(r, c, i): clipped_area(ring, c * 0.01, r * 0.01, 0.01) for r, c in cells for i, ring in rings.items()}
    assert {k for k, a in want.items() if a > 1e-9} == set(got)
    for k, a in got.items():
        assert a == pytest.approx(want[k], abs=1e-9)


def test_demand_model_covers_held_out_rows(spark):
    rnd = random.Random(4)
    rows = []
    for day in range(19725, 19753):
        for hour in range(24):
            mean = 3 + 2 * (7 <= hour <= 19)
            out = rnd.random() < 0.2
            y = sum(rnd.random() < (0.05 if out else 1) * mean / 40 for _ in range(40))
            rows.append((hour % 5, day * 86400 + hour * 3600, y, rnd.randrange(6), 0.05 if out else 1.0))
    f = spark.createDataFrame(rows, "station_id long, tick long, rental_count long, rental_lag_1h int, exposure double")
    got = models.demand(f).collect()
    assert len(got) == len(rows) and all(0 <= r.safe_lo <= r.lo + 1e-9 and r.lo <= r.hi <= r.safe_hi + 1e-9 for r in got)
    late = [r for r in got if not r.early]
    assert sum(r.safe_lo - 1e-3 <= r.y <= r.safe_hi + 1e-3 for r in late) >= 0.8 * len(late)
    assert abs(sum(r.mu for r in got if r.early) / sum(r.y for r in got if r.early) - 1) < 0.1


def test_nowcast_reads_no_later_day(spark):
    day = 20000
    old = [(1, day - 60, 10.0), (1, day - 59, 30.0)]
    later = [(1, day, 9999.0), (1, day + 1, 9999.0), (1, day - 6, 50.0)]
    est = lambda rows: {r.target: (r.estimate, r.method) for r in people.nowcast(spark.createDataFrame(rows, "k long, day long, v double"), day, day + 1, ["k"], "v").collect()}
    assert est(old)[day] == (20.0, "grid_historical_avg")
    assert est(old + later)[day] == (30.0, "grid_historical_avg")
    week = [(1, day - 7 * k, 100.0 * k) for k in range(1, 5)]
    assert est(week)[day] == (pytest.approx(200.0), "weighted_avg")
    assert est([week[0], *week[2:]])[day] == (pytest.approx(200.0), "reweighted_avg")
    assert est(week[1:2] + later)[day] == (200.0, "single_week_fallback")
    assert est([(1, day - 42, 250.0), (1, day - 49, 1.0), *later])[day] == (250.0, "extended_lookback_fallback")
    assert est([(1, day, 5.0)])[day] == (0.0, "no_data")


def test_density_blend(spark):
    base = spark.createDataFrame([(1, 100.0), (2, 7.0)], "cell long, s0 double")
    over = spark.createDataFrame([(1, 5, 62500.0, 18750 / 62500, 60, 200.0)], "cell long, poi long, area double, w double, male long, pop double")
    got = {r.cell: (r.s, r.male) for r in people.blended(base, over, ["cell"]).collect()}
    assert got == {1: (pytest.approx(130.0), 60), 2: (7.0, None)}


def test_collapse_or_fail(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, v string")
    assert sorted(r.id for r in sets.collapse_or_fail(rows, ["id"]).collect()) == [1, 2]
    with pytest.raises(ValueError):
        sets.collapse_or_fail(rows.union(spark.createDataFrame([(2, "c")], rows.schema)), ["id"])


def test_order_and_first_few(spark):
    rnd = random.Random(1)
    rows = [(i % 3 == 0, rnd.randrange(500), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k boolean, v long, i long")
    got = {r.i: r.place for r in files.placed(df, ["v", "i"]).collect()}
    assert [got[i] for _, _, i in sorted(rows, key=lambda r: r[1:])] == list(range(2000))
    few = {r.k: r.a for r in files.first_few(df, "k", "i", 12, "a").collect()}
    assert few == {k: sorted(i for q, _, i in rows if q == k)[:12] for k in (True, False)}


def test_every_day_is_written_once_per_date(spark, sf):
    df = stations(spark, sf).withColumn("date", F.expr("date_add(date'2024-01-01', int(station_id % 3))"))
    path = files.work_folder(spark, "t")
    files.write_by_date(df, path)
    assert spark.read.parquet(path).count() == df.count()

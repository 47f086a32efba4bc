"""Registered queries against their SQL on a small scale: a few of each kind, to keep the run short."""

import math
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["w01_censored_rolling_counts", "j05_as_of_lookup", "j06_bounded_forward_fill", "c06_feature_table", "v09_batch_result", "a13_split_conformal", "w10_clamped_stock", "c07_multi_horizon_table", "c08_population_nowcast", "c12_age_sex_redistribution", "c20_inference_features", "c25_move_quantity", "c27_truck_loads", "s21_cold_bundle", "t04_late_data_replay", "w21_stock_replay", "s17_dynamic_overwrite", "s23_guarded_upsert", "t01_tick_windows", "t05_incremental_equals_full", "j12_point_in_polygon", "d08_snapshot_selection", "u07_station_changes", "p17_purged_split", "p21_lambert_grid", "p28b_nearest_boundary", "j14b_nearest_of_many", "t03b_window_trend", "t04b_recompute_marked_days", "s20_change_signature", "s22_retention_candidates", "c14_station_enrichment", "c15_station_dimension", "c16_activation_readiness", "c29b_forecast_alignment", "c30_serving_health", "c32_route_aggregate", "c35_archive_load", "w21b_replay_timings", "w13_adverse_path", "v11b_missing_and_overfetch", "v18_panel_completeness", "a04_cell_hour_totals", "d11_donor_order"]


def cell(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}"
    return str(v)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, sf, duck, name):
    df = __spark_entry__.queries()[name](spark, sf)
    got = duck.execute(__spark_entry__.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(map(cell, r)) for r in got.fetchall())
    assert sorted(tuple(map(cell, r)) for r in df.select(*cols).collect()) == want


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) > 150


def test_stops_come_in_nearest_neighbour_order(spark, sf):
    """Each stop is the nearest of those that are left, ties to the smaller id; a route starts at its smallest station."""
    from tidewheel.plans.base import stations

    place = {r.station_id: (r.lat, r.lon) for r in stations(spark, sf).collect()}
    routes = {}
    for r in __spark_entry__.queries()["p32_nearest_neighbour_order"](spark, sf).collect():
        routes.setdefault(r.route, []).append((r.visit, r.station_id))
    assert sorted(i for stops in routes.values() for _, i in stops) == sorted(place)
    for stops in routes.values():
        got = [i for _, i in sorted(stops)]
        left, want = sorted(got), []
        while left:
            here = place[want[-1]] if want else None
            want.append(min(left, key=lambda i: ((place[i][0] - here[0]) ** 2 + (place[i][1] - here[1]) ** 2, i)) if here else left[0])
            left.remove(want[-1])
        assert got == want


@pytest.mark.parametrize("absent", ["regex", "tidewheel.llm", "corpus_pipeline"])
def test_core_queries_stand_alone(absent):
    """Without the subpackage, the pipeline or a library that only they use, the core's queries are all there."""
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; from tidewheel.plans import registry as r; assert set(e.queries()) == set(r.queries()) and len(e.queries()) > 230"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)

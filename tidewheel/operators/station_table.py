"""The station dimension: last known good values, moves that need approval, activation, and the enrichment of its master table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.files import stored

#: A place further away than this needs approval; a station without a valid window this many times in a row is closed (fixed values).
FAR_METRES, CLOSED_AFTER = 100.0, 3
#: Share of a master table's stations that must fall into known cells (fixed value).
MAPPED_SHARE = 0.95

WINDOW = "name string, capacity bigint, lat double, lon double, seen_s bigint"


def _valid(w):
    return w.isNotNull() & (F.trim(w["name"]) != "") & w["capacity"].isNotNull()


def _point(lat, lon):
    """A place, or null where either side is missing or outside the globe."""
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def _metres(a, b):
    return geo.haversine(a["lat"], a["lon"], b["lat"], b["lon"])


def fold_windows(windows: DataFrame) -> DataFrame:
    """windows (station_id, no, name, capacity, lat, lon, seen_s; no 1 is the newest) -> station_id, newest (the row of window 1 or
    null), streak (windows from the newest on without a valid row; windows that lack the station count).

    One aggregation: the streak ends at the first valid window, so no window function is needed."""
    count = windows.agg(F.max("no")).first()[0] or 0
    row = F.struct(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in WINDOW.split(", ")])
    per = windows.withColumn("_w", row).groupBy("station_id")
    first = F.min(F.when(_valid(F.col("_w")), F.col("no")))
    return per.agg(F.max(F.when(F.col("no") == 1, F.col("_w"))).alias("newest"), (F.coalesce(first, F.lit(count + 1)) - 1).alias("streak"))


def project(master: DataFrame, windows: DataFrame, previous: DataFrame, ready: DataFrame, approvals: DataFrame, base_s: int) -> DataFrame:
    """The next station table, before centres and cells.

    master: station_id, address, lat, lon (a snapshot of time base_s). windows: as in fold_windows(). previous: station_id, name,
    address, capacity, lat, lon, source, base_s, seen_s, active. ready: station_id. approvals: station_id, comparison
    (`previous` or `realtime`), lat, lon: the master's place that was approved against it.

    Candidates are stations of the previous table and of the newest window; a new one needs a valid row and a place. The
    master's place holds unless it is more than FAR_METRES from the previous or the newest window's place without
    approval; then, and where the master has no address or, for a known station, no place, the previous values stay
    (`kept`). A new station without a master place takes the window's. A valid window row keeps an active station
    active and opens one that is ready; without one an active station stays open until CLOSED_AFTER windows. Adds `change`:
    insert, activate, deactivate, move, update or same. Columns: those of previous, kept, change, used (approvals that were needed)."""
    was = previous.select("station_id", F.struct("name", "address", "capacity", "lat", "lon", "source", "base_s", "seen_s", "active").alias("p"))
    seen = fold_windows(windows)
    known = master.groupBy("station_id").agg(F.min(F.struct("address", "lat", "lon")).alias("m"))
    good = approvals.groupBy("station_id").agg(F.collect_set(F.struct("comparison", "lat", "lon")).alias("_ok"))  # two comparisons a station
    both = was.join(seen, "station_id", "full").join(known, "station_id", "left").join(good, "station_id", "left")
    both = both.join(ready.select("station_id").distinct().withColumn("_ready", F.lit(True)), "station_id", "left")
    p, w, m = F.col("p"), F.col("newest"), F.col("m")
    streak = F.coalesce("streak", F.lit(CLOSED_AFTER))
    both = both.where(p.isNotNull() | _valid(w))
    both = both.withColumns({"_mp": _point(m["lat"], m["lon"]), "_wp": _point(w["lat"], w["lon"]), "_pp": _point(p["lat"], p["lon"]), "_valid": F.coalesce(_valid(w), F.lit(False))})
    mp = F.col("_mp")
    far = {c: F.coalesce(_metres(mp, F.col(at)) > FAR_METRES, F.lit(False)) for c, at in (("previous", "_pp"), ("realtime", "_wp"))}
    approved = {c: F.coalesce(F.array_contains("_ok", F.struct(F.lit(c).alias("comparison"), mp["lat"].alias("lat"), mp["lon"].alias("lon"))), F.lit(False)) for c in far}
    refused = (far["previous"] & ~approved["previous"]) | (far["realtime"] & ~approved["realtime"])
    choice = (
        F.when(m["address"].isNull(), "previous")
        .when(mp.isNull() & p.isNotNull(), "previous")
        .when(mp.isNull(), "realtime")
        .when(refused, "previous")
        .otherwise("master")
    )
    needed = F.filter(F.array(*[F.when(far[c] & approved[c], c) for c in far]), lambda x: x.isNotNull())
    both = both.withColumns({"_choice": choice, "_needed": needed})
    both = stored(both, "station-choices")  # the choices enter many columns; a stored table keeps them from being computed in each
    used = F.when(F.col("_choice") == "master", F.col("_needed")).otherwise(F.array().cast("array<string>"))
    place = F.when(F.col("_choice") == "master", mp).when(F.col("_choice") == "realtime", F.col("_wp")).otherwise(F.col("_pp"))
    from_master = F.col("_choice") != "previous"
    was_active = F.coalesce(p["active"], F.lit(False))
    active = F.when(F.col("_valid"), was_active | F.coalesce("_ready", F.lit(False))).otherwise(was_active & (streak < CLOSED_AFTER))
    out = both.withColumns({"_place": place, "active": active, "used": used}).where(F.col("_place").isNotNull() & (p.isNotNull() | from_master))
    moved = F.coalesce(_metres(F.col("_place"), F.col("_pp")) > 0, F.lit(True))
    name, capacity = F.when(F.col("_valid"), w["name"]).otherwise(p["name"]), F.when(F.col("_valid"), w["capacity"]).otherwise(p["capacity"])
    address = F.when(from_master, m["address"]).otherwise(p["address"])
    same = name.eqNullSafe(p["name"]) & capacity.eqNullSafe(p["capacity"]) & address.eqNullSafe(p["address"])
    change = F.when(p.isNull(), "insert").when(active & ~was_active, "activate").when(~active & was_active, "deactivate").when(moved, "move").when(~same, "update").otherwise("same")
    return out.select(
        "station_id",
        name.alias("name"),
        address.alias("address"),
        capacity.alias("capacity"),
        F.col("_place.lat").alias("lat"),
        F.col("_place.lon").alias("lon"),
        F.when(F.col("_choice") == "previous", p["source"]).otherwise(F.col("_choice")).alias("source"),
        F.when(from_master, F.lit(base_s).cast("long")).otherwise(p["base_s"]).alias("base_s"),
        F.coalesce(w["seen_s"], p["seen_s"]).alias("seen_s"),
        "active",
        (~from_master).alias("kept"),
        change.alias("change"),
        "used",
    )


def require_all_used(projected: DataFrame, approvals: DataFrame) -> None:
    """Raises if an approval was given that the projection did not need."""
    used = projected.select("station_id", F.explode("used").alias("comparison"))
    spare = approvals.select("station_id", "comparison").join(used, ["station_id", "comparison"], "left_anti").limit(5).collect()
    if spare:
        raise ValueError(f"approvals that nothing needed: {[tuple(r) for r in spare]}")


def weather_cell(lat, lon):
    nx, ny = geo.lambert_cell(lat, lon)
    return F.concat_ws("_", nx, ny)


def enrich(master: DataFrame, live: DataFrame, cells: DataFrame, least: float = MAPPED_SHARE) -> DataFrame:
    """master (station_id, capacity, lat, lon) with live values over it, and the 5 km weather cell of its place: adds `weather_cell` (null where
    cells, a list of known ones, lacks it) and `place_source`.

    A live place counts only whole; else the master's. Raises if fewer than `least` of the stations that have a place
    fall into a known cell."""
    lp, mp = _point(F.col("live_lat"), F.col("live_lon")), _point(F.col("lat"), F.col("lon"))
    now = live.select("station_id", F.col("capacity").alias("live_capacity"), F.col("lat").alias("live_lat"), F.col("lon").alias("live_lon"))
    both = master.join(now, "station_id", "left").withColumns({"_lp": lp, "_mp": mp})
    at = F.coalesce("_lp", "_mp")
    source = F.when(F.col("_lp").isNotNull(), "live").when(F.col("_mp").isNotNull(), "master")
    both = both.withColumns({"_at": at, "place_source": source, "capacity": F.coalesce("live_capacity", "capacity")})
    both = both.withColumns({"lat": F.col("_at.lat"), "lon": F.col("_at.lon")}).withColumn("_cell", weather_cell(F.col("lat"), F.col("lon")))
    known = cells.select(F.col("weather_cell")).distinct()
    out = both.join(known, F.col("_cell") == F.col("weather_cell"), "left").select("station_id", "capacity", "lat", "lon", "place_source", "weather_cell")
    placed, mapped = out.agg(F.count("lat"), F.count("weather_cell")).first()
    if placed and mapped < least * placed:
        raise ValueError(f"only {mapped} of {placed} stations fall into known weather cells")
    return out

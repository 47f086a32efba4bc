"""Serving tables: health over all publications, stations with aligned stock, forecasts with their state, routes with numbers, ranks and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Worst first (fixed values).
STATES = ("missing", "expired", "misaligned", "stale", "ready")
#: Seconds that data of a publication is fresh, and after which it has expired (fixed values); None never expires.
MINUTES_10, HOUR, HOURS_36, AHEAD = 600, 3600, 129600, 300
#: component -> (publication key, fresh, expired).
CORE = {
    "stock": ("station_stock", MINUTES_10, HOUR),
    "demand": ("station_demand_forecast", MINUTES_10, HOUR),
    "urgency": ("station_urgency", MINUTES_10, HOUR),
    "routes": ("rebalance_route", MINUTES_10, HOUR),
}
EVENTS = ("event:cultural_event", "event:performance_event")
KEYS = ("dispatch_center", "station", *(k for k, _, _ in CORE.values()), "weather_forecast", *EVENTS)


def state_of(logical, now, fresh: int, expired: int | None):
    """missing for null; ready inside freshness (five minutes ahead count); expired beyond expiry; else stale."""
    out = F.when(logical.isNull(), "missing").when(logical.between(now - fresh, now + AHEAD), "ready")
    if expired is not None:
        out = out.when(now - logical > expired, "expired")
    return out.otherwise("stale")


def worst(a, b):
    """The worse of two states and the data that goes with it: structs (state, reason, data_s) in the order of STATES."""
    place = lambda s: F.array_position(F.array(*map(F.lit, STATES)), s["state"])
    return F.when(place(b) < place(a), b).otherwise(a)


def health(anchors: DataFrame, states: DataFrame, weather: DataFrame) -> DataFrame:
    """anchors (now); states (now, key, logical_s, n: a row per publication); weather (now, n, expected, fresh, oldest_s: its
    horizon's rows) -> a row per anchor and component: now, component, state, reason, data_s, age_min, can_dispatch, overall.

    Publications that have no row count as missing. Stock must have the stations' anchor, and the four core components one
    anchor; weather must be whole, then of a fresh issue; of the two event sources the worse one counts, with the
    older data; centres must be there. overall: unavailable if stock or demand is missing or expired, healthy if all is
    ready, else degraded. One aggregation turns an anchor's publications into a row; nothing else is grouped."""
    per = states.where(F.col("key").isin(*KEYS)).groupBy("now")
    wide = per.agg(*[F.max(F.when(F.col("key") == k, F.struct("logical_s", "n"))).alias(f"p{i}") for i, k in enumerate(KEYS)])
    row = anchors.select("now").distinct().join(wide, "now", "left").join(weather.select("now", F.struct("n", "expected", "fresh", "oldest_s").alias("w")), "now", "left")
    now, at = F.col("now"), {k: F.col(f"p{i}.logical_s") for i, k in enumerate(KEYS)}
    entry = lambda state, reason, data: F.struct(state.alias("state"), reason.alias("reason"), data.cast("long").alias("data_s"))
    told = lambda s: F.when(s == "missing", "not_published").when(s == "ready", "fresh").when(s == "expired", "publication_expired").otherwise("publication_stale")
    plain = {c: state_of(at[k], now, fresh, expired) for c, (k, fresh, expired) in CORE.items()}
    stock = F.when(at["station"].isNull(), "missing").when(~plain["stock"].isin("missing", "expired") & (at["station"] != at["station_stock"]), "misaligned").otherwise(plain["stock"])
    row = row.withColumns({"_stock": stock, **{f"_{c}": plain[c] for c in ("demand", "urgency", "routes")}})
    core = {c: F.col(f"_{c}") for c in CORE}
    ready = core["stock"].isin("ready") & core["demand"].isin("ready") & core["urgency"].isin("ready") & core["routes"].isin("ready")
    times = [at[k] for k, _, _ in CORE.values()]
    row = row.withColumns({"_ready": ready, "_one": F.coalesce((F.least(*times) == F.greatest(*times)), F.lit(False))})
    apart = F.col("_ready") & ~F.col("_one")
    anchor_of = lambda c: F.when((core[c] == "missing"), F.lit(None)).otherwise(at[CORE[c][0]])
    parts = {}
    for c in CORE:
        reason = F.when(apart, "operational_anchor_mismatch").when(core[c] == "misaligned", "station_stock_anchor_mismatch").otherwise(told(core[c]))
        parts[c] = entry(F.when(apart, "misaligned").otherwise(core[c]), reason, anchor_of(c))
    w, issued = F.col("w"), state_of(at["weather_forecast"], now, MINUTES_10, HOUR)
    short = F.coalesce(w["n"] != w["expected"], F.lit(True))
    old = ~F.coalesce(w["fresh"], F.lit(False))
    weather_state = F.when((issued == "ready") & short, "misaligned").when((issued == "ready") & old, "stale").otherwise(issued)
    weather_reason = F.when((issued == "ready") & short, "weather_horizon_incomplete").when((issued == "ready") & old, "weather_issue_stale").otherwise(told(issued))
    parts["weather"] = entry(weather_state, weather_reason, F.when(issued != "missing", w["oldest_s"]))
    one, two = (entry(state_of(at[k], now, HOURS_36, None), told(state_of(at[k], now, HOURS_36, None)), at[k]) for k in EVENTS)
    bad = worst(one, two)
    both = (one["state"] == "ready") & (two["state"] == "ready")
    known = F.coalesce(at[EVENTS[0]], at[EVENTS[1]]).isNotNull()
    parts["events"] = entry(bad["state"], F.when(~known, "not_published").when(both, "fresh").otherwise("event_source_incomplete"), F.least(at[EVENTS[0]], at[EVENTS[1]]))
    there = F.coalesce(F.col("p0.n") > 0, F.lit(False))
    parts["regions"] = entry(F.when(there, "ready").otherwise("missing"), F.when(there, "fresh").otherwise("not_published"), at["dispatch_center"])
    row = row.select("now", (F.col("_ready") & F.col("_one")).alias("can_dispatch"), *[v.alias(c) for c, v in parts.items()])
    gone = F.col("stock.state").isin("missing", "expired") | F.col("demand.state").isin("missing", "expired")
    every = F.array(*[F.col(f"{c}.state") for c in parts])
    overall = F.when(gone, "unavailable").when(F.forall(every, lambda s: s == "ready"), "healthy").otherwise("degraded")
    listed = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"{c}.state").alias("state"), F.col(f"{c}.reason").alias("reason"), F.col(f"{c}.data_s").alias("data_s")) for c in parts])
    out = row.select("now", "can_dispatch", overall.alias("overall"), F.inline(listed))
    age = F.bround(F.greatest(F.lit(0), F.col("now") - F.col("data_s")) / 60.0, 1)
    return out.select("now", "component", "state", "reason", "data_s", F.when(F.col("data_s").isNotNull(), age).alias("age_min"), "can_dispatch", "overall")


def station_rows(stations: DataFrame, stock: DataFrame, now: int, allow_stale: bool = False) -> DataFrame:
    """Active stations (station_id, .., seen_s, active) with the stock row (station_id, base_s, bikes) of the very time they were last
    seen, not from the future and, unless stale rows are allowed, ten minutes old at most."""
    here = stock.select("station_id", F.col("base_s").alias("seen_s"), "bikes")
    rows = stations.where("active").join(here, ["station_id", "seen_s"]).where(F.col("seen_s") <= now + AHEAD)
    return rows if allow_stale else rows.where(F.col("seen_s") >= now - MINUTES_10)


def forecast_states(stations: DataFrame, panel: DataFrame, stock: DataFrame, now: int, hours: int = 12, allow_stale: bool = False) -> DataFrame:
    """Per station of the list or the panel: station_id, state, points.

    panel: station_id, base_s, target_s, rent, ret. States in order: station_not_found (not in the list or closed);
    forecast_not_ready (the whole panel has not one base, or it is not fresh); forecast_not_available (no row); forecast_not_ready
    (not exactly the `hours` hours after the base); stock_not_aligned (no stock row of the base, or the station was seen at
    another time); ready, with its points in order of time."""
    base = panel.agg(F.min("base_s").alias("_lo"), F.max("base_s").alias("_hi"))  # one row
    one = F.col("_lo").isNotNull() & (F.col("_lo") == F.col("_hi")) & (F.col("_lo") <= now + AHEAD) & (F.lit(allow_stale) | (F.col("_lo") >= now - MINUTES_10))
    point = F.struct("target_s", "rent", "ret")
    first_few = F.slice(F.array_sort(F.collect_list(point)), 1, hours)  # a panel has `hours` rows a station
    per = panel.groupBy("station_id").agg(F.count("*").alias("_n"), F.min("target_s").alias("_first"), F.max("target_s").alias("_last"), F.count_distinct("target_s").alias("_times"), F.max(F.col("target_s") % 3600).alias("_off"), F.min(F.col("target_s") % 3600).alias("_off0"), first_few.alias("points"))
    listed = stations.where("active").select("station_id", "seen_s", F.lit(True).alias("_known"))
    every = listed.join(per, "station_id", "full").join(stock.select("station_id", "base_s", F.col("bikes").alias("_bikes")), "station_id", "left").join(F.broadcast(base))
    whole = (F.col("_n") == hours) & (F.col("_times") == hours) & (F.col("_first") == F.col("_lo") + 3600) & (F.col("_last") == F.col("_lo") + hours * 3600) & (F.col("_off") == F.col("_off0"))
    whole = whole & (F.lit(allow_stale) | (F.col("_first") > now))
    aligned = (F.col("base_s") == F.col("_lo")) & (F.col("seen_s") == F.col("base_s"))
    state = (
        F.when(F.col("_known").isNull(), "station_not_found")
        .when(~one, "forecast_not_ready")
        .when(F.col("_n").isNull(), "forecast_not_available")
        .when(~whole, "forecast_not_ready")
        .when(~F.coalesce(aligned, F.lit(False)), "stock_not_aligned")
        .otherwise("ready")
    )
    return every.withColumn("state", state).select("station_id", "state", F.when(F.col("state") == "ready", F.col("points")).alias("points"))


def route_rows(routes: DataFrame, stops: DataFrame, urgency: DataFrame) -> DataFrame:
    """Routes with their number among a centre's dispatched ones of the day, the rank of proposed ones, and their stops.

    routes: route_id, center_id, status, proposed_s, dispatched_s. stops: route_id, visit, station_id, action, bikes. urgency:
    station_id, base_s, score. A proposal ranks by the score of its first drop-off at its proposal's time, then by station;
    without a score it has no rank. Stops are nested in order of visit, an empty list for none."""
    stop = F.struct("visit", "station_id", "action", "bikes")
    nested = stops.groupBy("route_id").agg(F.array_sort(F.collect_list(stop)).alias("stops"), F.min(F.when(F.col("action") == "dropoff", F.struct("visit", "station_id"))).alias("_drop"))
    day = F.floor(F.col("dispatched_s") / 86400)
    sent = routes.where("dispatched_s is not null").withColumn("work_no", F.row_number().over(W.partitionBy("center_id", day).orderBy("dispatched_s", "route_id")).cast("long"))
    full = routes.join(nested, "route_id", "left").withColumn("anchor", F.col("_drop.station_id"))
    asked = full.where("status = 'proposed'").select("route_id", "center_id", "proposed_s", "anchor")
    scored = asked.join(urgency.select(F.col("station_id").alias("anchor"), F.col("base_s").alias("proposed_s"), "score"), ["anchor", "proposed_s"])
    rank = F.dense_rank().over(W.partitionBy("center_id", "proposed_s").orderBy(F.desc("score"), "anchor")).cast("long")
    out = full.join(sent.select("route_id", "work_no"), "route_id", "left").join(scored.select("route_id", rank.alias("priority")), "route_id", "left")
    none = F.array().cast("array<struct<visit: bigint, station_id: bigint, action: string, bikes: bigint>>")
    kind = "array<struct<visit: bigint, station_id: bigint, action: string, bikes: bigint>>"
    return out.select("route_id", "center_id", "status", "work_no", "priority", "anchor", F.coalesce(F.col("stops").cast(kind), none).alias("stops"))

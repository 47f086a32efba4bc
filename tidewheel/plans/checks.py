"""Data-quality rules over dirty views of customer and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as Q
from ..operators.rolling import future_counts
from .base import forecast, query, seconds, stations, table, trips, weather
from .rolling import FUTURE_SQL

RULES = [
    {"name": "bal", "types": ["float"], "required": True, "min": -500.0, "max": 9000.0, "on_outlier": "clip_to_range"},
    {"name": "seg", "types": ["str"], "required": False, "enum": ["BUILDING", "AUTOMOBILE", "HOUSEHOLD"], "on_missing": "fill_default", "default": "NONE"},
    {"name": "qty", "types": ["int", "float"], "required": False, "min": 0, "max": 900, "on_missing": "fill_zero"},
    {"name": "code", "types": ["int"], "required": True},
]
DIRTY = """SELECT c_custkey, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS seg,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 'bad' ELSE {text} END AS qty, CASE WHEN c_custkey % 31 = 0 THEN 'x' WHEN c_custkey % 37 = 0 THEN NULL ELSE {key} END AS code FROM {t}"""


def dirty(spark, sf):
    # dealt out: a small file of many rows is one task's otherwise
    c = table(spark, sf, "customer").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.sql(DIRTY.format(text="CAST(c_custkey / 2 AS STRING)", key="CAST(c_custkey AS STRING)", t="{c}"), c=c)


_D = f"""d AS ({DIRTY.format(text="CAST(c_custkey / 2 AS VARCHAR)", key="CAST(c_custkey AS VARCHAR)", t="customer")}),
k AS (SELECT *, try_cast(qty AS DOUBLE) AS q, CASE WHEN bal IS NULL THEN 'missing' WHEN bal < -500 OR bal > 9000 THEN 'outlier' END AS kb, CASE WHEN seg IS NULL OR trim(seg) = '' THEN 'missing' WHEN seg NOT IN ('BUILDING', 'AUTOMOBILE', 'HOUSEHOLD') THEN 'outlier' END AS ks,
  CASE WHEN qty IS NULL THEN 'missing' WHEN try_cast(qty AS DOUBLE) IS NULL THEN 'type' WHEN try_cast(qty AS DOUBLE) > 900 THEN 'outlier' END AS kq, CASE WHEN code IS NULL THEN 'missing' WHEN try_cast(code AS BIGINT) IS NULL THEN 'type' END AS kc FROM d),
v AS (SELECT *, CASE WHEN kb = 'missing' OR kc IS NOT NULL THEN 'dropped' WHEN kb IS NOT NULL OR ks IS NOT NULL OR kq IS NOT NULL THEN 'repaired' ELSE 'ok' END AS st FROM k)"""


def checked(spark, sf):
    return Q.validate(dirty(spark, sf), RULES)


@query("v01_multi_type_cast", f"WITH {_D} SELECT c_custkey, q FROM v")
def v01(spark, sf):
    return dirty(spark, sf).select("c_custkey", Q.first_cast(F.col("qty"), ["int", "float"]).alias("q"))


@query("v02_column_verdict", f"WITH {_D} SELECT c_custkey, kb, ks, kq, kc FROM v")
def v02(spark, sf):
    d = dirty(spark, sf)
    return d.select("c_custkey", *[Q.verdict(F.col(r["name"]), r)["kind"].alias("k" + r["name"][0]) for r in RULES])


@query("v03_policy_choice", f"""WITH {_D}, long AS (SELECT c_custkey, 'bal' AS col, kb AS kind FROM v UNION ALL SELECT c_custkey, 'seg', ks FROM v UNION ALL SELECT c_custkey, 'qty', kq FROM v UNION ALL SELECT c_custkey, 'code', kc FROM v)
SELECT c_custkey, col, kind, CASE WHEN col = 'bal' THEN CASE kind WHEN 'missing' THEN 'drop_row' ELSE 'clip_to_range' END WHEN col = 'code' THEN 'drop_row' WHEN kind = 'missing' THEN CASE col WHEN 'seg' THEN 'fill_default' ELSE 'fill_zero' END ELSE 'set_null' END AS policy
FROM long WHERE kind IN ('missing', 'outlier')""")
def v03(spark, sf):
    """The policy for each issue found: the column's own if it names one, else the default of its kind. The choice is
    made on the driver, per rule and kind, and goes into the plan as literals."""
    d = dirty(spark, sf)
    chosen = lambda r: F.create_map(*[F.lit(x) for k in ("missing", "outlier") for x in (k, Q.policy(r, k))])
    issues = F.array(*[F.struct(F.lit(r["name"]).alias("col"), Q.verdict(F.col(r["name"]), r)["kind"].alias("kind"), chosen(r).alias("by")) for r in RULES])
    found = d.select("c_custkey", F.inline(issues)).where("kind in ('missing', 'outlier')")
    return found.select("c_custkey", "col", "kind", F.element_at("by", F.col("kind")).alias("policy"))


@query("v04_fill_policies", f"WITH {_D} SELECT c_custkey, CASE WHEN ks = 'missing' THEN 'NONE' WHEN ks IS NULL THEN seg END AS seg, CASE WHEN kq = 'missing' THEN 0 WHEN kq IS NULL THEN q END AS qty FROM v")
def v04(spark, sf):
    return checked(spark, sf).select("c_custkey", "seg", "qty")


@query("v05_clip_to_range", f"WITH {_D} SELECT c_custkey, CASE WHEN bal IS NOT NULL THEN least(greatest(bal, -500.0), 9000.0) END AS bal FROM v")
def v05(spark, sf):
    return checked(spark, sf).select("c_custkey", "bal")


@query("v06_drop_row", f"WITH {_D} SELECT c_custkey FROM v WHERE st <> 'dropped'")
def v06(spark, sf):
    return Q.clean(checked(spark, sf)).select("c_custkey")


@query("v07_fail_batch", f"WITH {_D} SELECT count(*) FILTER (WHERE kc IS NOT NULL)::BIGINT AS failed, count(*) FILTER (WHERE kc IS NOT NULL) = 0 AS pass FROM v")
def v07(spark, sf):
    rules = [*RULES[:3], RULES[3] | {"on_missing": "fail_batch", "on_outlier": "fail_batch"}]
    return Q.gates(Q.validate(dirty(spark, sf), rules)).select("failed", (F.col("failed") == 0).alias("pass"))


@query("v08_row_rules", f"WITH {_D}, n AS (SELECT c_custkey, (kb IS NOT NULL)::INT + (ks IS NOT NULL)::INT + (kq IS NOT NULL)::INT + (kc IS NOT NULL)::INT AS n, kb IS NOT NULL OR kc IS NOT NULL AS any_required FROM v) SELECT c_custkey, n, any_required, n > 1 AS too_many FROM n")
def v08(spark, sf):
    return checked(spark, sf).select("c_custkey", F.size("_issues").alias("n"), F.exists("_issues", lambda i: i["required"]).alias("any_required"), (F.size("_issues") > 1).alias("too_many"))


@query("v09_batch_result", f"WITH {_D} SELECT c_custkey, st AS status FROM v")
def v09(spark, sf):
    v = checked(spark, sf)
    return Q.clean(v).select("c_custkey", F.col("_row_status").alias("status")).unionByName(Q.quarantine(v).select("c_custkey", F.col("_row_status").alias("status")))


@query("v10_issue_counts", f"""WITH {_D} SELECT c AS "column", kind, action, count(*)::BIGINT AS n FROM (SELECT 'bal' AS c, kb AS kind, CASE kb WHEN 'missing' THEN 'drop_row' ELSE 'clip_to_range' END AS action FROM v UNION ALL SELECT 'seg', ks, CASE ks WHEN 'missing' THEN 'fill_default' ELSE 'set_null' END FROM v
UNION ALL SELECT 'qty', kq, CASE kq WHEN 'missing' THEN 'fill_zero' ELSE 'set_null' END FROM v UNION ALL SELECT 'code', kc, 'drop_row' FROM v) WHERE kind IS NOT NULL GROUP BY ALL""")
def v10(spark, sf):
    return Q.issue_counts(checked(spark, sf))


@query("v11_batch_gates", f"WITH {_D} SELECT count(*)::BIGINT AS fetched, count(*) FILTER (WHERE st <> 'dropped')::BIGINT AS kept, count(*) FILTER (WHERE st = 'repaired')::BIGINT AS repaired, count(*) FILTER (WHERE st = 'dropped')::BIGINT AS dropped, 0::BIGINT AS failed, round_even(count(*) FILTER (WHERE st = 'dropped') / count(*), 6) AS drop_ratio, count(*) FILTER (WHERE st = 'dropped') / count(*) <= 0.5 AS pass FROM v")
def v11(spark, sf):
    return Q.gates(checked(spark, sf))


_GATES_SQL = f"""
WITH {_D},
c AS (SELECT c_nationkey % 5 AS batch, v.st FROM v JOIN customer USING (c_custkey)),
p AS (SELECT c_nationkey % 5 AS batch, count(*) AS n FROM customer GROUP BY ALL),
g AS (SELECT batch, count(*) AS fetched, count(*) FILTER (WHERE st = 'dropped') / count(*) AS drop_ratio, count(*) FILTER (WHERE st = 'failed') AS failed FROM c GROUP BY ALL),
r AS (
  SELECT g.*, CASE WHEN batch = 1 THEN 1 / 8 WHEN batch = 4 THEN 0 WHEN batch = 2 THEN greatest(0, 1 - fetched / (n + 40)) WHEN batch = 3 THEN greatest(0, 1 - fetched / (n - 40)) ELSE 0 END AS missing,
    CASE WHEN batch = 3 THEN greatest(0, fetched / (n - 40) - 1) ELSE 0 END AS over
  FROM g JOIN p USING (batch))
SELECT batch::BIGINT AS batch, fetched, round_even(drop_ratio, 6) AS drop_ratio, round_even(missing, 6) AS missing_ratio, round_even(over, 6) AS over_ratio,
  failed = 0 AND drop_ratio <= 0.5 AND missing <= 0.1 AND over <= 0.05 AS pass FROM r"""


@query("v11b_missing_and_overfetch", _GATES_SQL)
def v11b(spark, sf):
    """Five batches by nation against what their source announced: exactly, by parts with one of eight missing, 40 rows
    more, 40 rows fewer, and nothing missing of three parts."""
    v = checked(spark, sf).join(table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 5).cast("long").alias("batch")), "c_custkey")
    n = {r.batch: r.n for r in v.groupBy("batch").agg(F.count("*").alias("n")).collect()}  # five rows
    plans = {0: (0, 0, 1), 1: (None, 1, 7), 2: (40, 0, 1), 3: (-40, 0, 1), 4: (None, 0, 3)}
    out = None
    for batch, (more, missing, got) in plans.items():
        plan = spark.createDataFrame([(None if more is None else n.get(batch, 0) + more, missing, got)], "planned long, parts_missing long, parts_got long")
        row = Q.gates(v.where(F.col("batch") == batch), plan=plan).select(F.lit(batch).cast("long").alias("batch"), "fetched", "drop_ratio", "missing_ratio", "over_ratio", "pass")
        out = row if out is None else out.unionByName(row)
    return out.where("fetched > 0")


@query("v12_natural_key", "SELECT count(*)::BIGINT AS n, count(DISTINCT (user_id, epoch_us(ts) // 3600000000))::BIGINT AS keys, count(*) FILTER (WHERE event_type IS NULL OR trim(event_type) = '')::BIGINT AS blank, count(*) = count(DISTINCT (user_id, epoch_us(ts) // 3600000000)) AS is_unique FROM events")
def v12(spark, sf):
    e = table(spark, sf, "events").withColumn("h", F.floor(seconds("ts") / 3600))
    keys = e.groupBy("user_id", "h").agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isNull() | (F.trim("event_type") == "")).alias("blank"))
    return keys.agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.sum("blank").alias("blank")).withColumn("is_unique", F.col("n") == F.col("keys"))


@query("v13_strict_hour", "SELECT event_id, strftime(ts, '%Y%m%d') AS ymd, hour(ts)::BIGINT AS hh FROM events")
def v13(spark, sf):
    """Eight-digit date and hour 00..23, or an error that names the value."""
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd").alias("ymd"), F.date_format("ts", "HH").alias("hh"))
    ok = F.col("ymd").rlike(r"^\d{8}$") & F.col("hh").rlike(r"^([01]\d|2[0-3])$")
    return e.select("event_id", "ymd", F.when(ok, F.col("hh").cast("long")).otherwise(F.raise_error(F.concat(F.lit("bad date or hour: "), "ymd", F.lit(" "), "hh")).cast("long")).alias("hh"))


@query("v14_digit_code", "SELECT c_custkey, lpad(c_custkey::VARCHAR, 8, '0') AS code FROM customer")
def v14(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.trim(F.concat(F.lit(" "), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))).alias("code"))
    return c.select("c_custkey", F.when(F.col("code").rlike(r"^\d{8}$"), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("bad code: "), "code")).cast("string")).alias("code"))


@query("v15_valid_observation", "SELECT event_id FROM weather WHERE temp IS NOT NULL AND temp BETWEEN -50 AND 50")
def v15(spark, sf):
    t = F.col("temp")
    return weather(spark, sf).where(t.isNotNull() & ~F.isnan(t) & t.between(-50, 50)).select("event_id")


@query("v16_eligibility_reason", "SELECT c_custkey, CASE WHEN s.s_suppkey IS NULL THEN 'not_in_master' WHEN s.s_acctbal < 0 THEN 'bad_master_row' WHEN c_custkey % 4 = 0 THEN 'untrained' ELSE 'eligible' END AS reason FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey % 150")
def v16(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    c = table(spark, sf, "customer").withColumn("k", F.col("c_custkey") % 150).join(s.withColumn("_m", F.lit(True)), "k", "left")
    return c.select("c_custkey", F.when(F.col("_m").isNull(), "not_in_master").when(F.col("s_acctbal") < 0, "bad_master_row").when(F.col("c_custkey") % 4 == 0, "untrained").otherwise("eligible").alias("reason"))


@query("v17_ineligible_ratio_gate", "WITH a AS (SELECT DISTINCT l_suppkey AS id FROM lineitem), t AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 10 <> 3), e AS (SELECT id FROM a INTERSECT SELECT id FROM t) SELECT (SELECT count(*) FROM a)::BIGINT AS active, (SELECT count(*) FROM e)::BIGINT AS eligible, 1 - (SELECT count(*) FROM e) / (SELECT count(*) FROM a) <= 0.2 AS pass")
def v17(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id")).distinct()
    t = table(spark, sf, "supplier").where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").alias("id"), F.lit(1).alias("ok"))
    return a.join(t, "id", "left").agg(F.count("*").alias("active"), F.count("ok").alias("eligible")).withColumn("pass", 1 - F.col("eligible") / F.col("active") <= 0.2)


_PANEL_SQL = """
WITH g AS (
  SELECT station_id, horizon, CASE WHEN station_id % 17 = 3 AND horizon > 9 THEN 1 ELSE 2 END AS base_s FROM forecast WHERE (station_id + horizon) % 50 <> 0
  UNION ALL SELECT station_id, horizon, 2 FROM forecast WHERE station_id % 23 = 1 AND horizon < 3
  UNION ALL SELECT station_id, 13, 2 FROM forecast WHERE station_id % 29 = 2 AND horizon = 1
  UNION ALL SELECT station_id + 1000000, horizon, 2 FROM forecast WHERE station_id % 31 = 4 AND horizon < 5),
s AS (SELECT DISTINCT station_id FROM forecast),
f AS (SELECT station_id, h AS horizon, true AS there FROM s, (SELECT unnest(range(1, 13)) AS h)),
c AS (SELECT station_id, horizon, count(*) AS n, count(*) FILTER (WHERE base_s <> 2) AS other FROM g GROUP BY ALL)
SELECT station_id, count(*) FILTER (WHERE n IS NULL)::BIGINT AS missing, count(*) FILTER (WHERE there IS NULL)::BIGINT AS extra, coalesce(sum(greatest(n - 1, 0)), 0)::BIGINT AS repeated,
  coalesce(sum(other), 0)::BIGINT AS other_base
FROM (SELECT station_id, horizon FROM f UNION SELECT station_id, horizon FROM c) k LEFT JOIN f USING (station_id, horizon) LEFT JOIN c USING (station_id, horizon) GROUP BY ALL"""


@query("v18_panel_completeness", _PANEL_SQL)
def v18(spark, sf):
    """A panel with holes, repeated rows, a thirteenth hour, rows of an older anchor and unknown stations, against 12 hours a station."""
    f = forecast(spark, sf)
    base = F.when((F.col("station_id") % 17 == 3) & (F.col("horizon") > 9), 1).otherwise(2).alias("base_s")
    two = F.lit(2).alias("base_s")
    g = f.where("(station_id + horizon) % 50 <> 0").select("station_id", "horizon", base)
    g = g.unionByName(f.where("station_id % 23 = 1 and horizon < 3").select("station_id", "horizon", two))
    g = g.unionByName(f.where("station_id % 29 = 2 and horizon = 1").select("station_id", F.lit(13).cast("long").alias("horizon"), two))
    g = g.unionByName(f.where("station_id % 31 = 4 and horizon < 5").select((F.col("station_id") + 1000000).alias("station_id"), "horizon", two))
    return Q.panel_gaps(g, f.select("station_id"))


@query("v19_coordinate_box", "SELECT station_id, lat BETWEEN 37.5 AND 37.6 AND lon BETWEEN 126.9 AND 127.1 AS ok FROM stations")
def v19(spark, sf):
    return stations(spark, sf).select("station_id", (F.col("lat").between(37.5, 37.6) & F.col("lon").between(126.9, 127.1)).alias("ok"))


@query("v20_key_format", "SELECT c_custkey, c_custkey AS no FROM customer WHERE c_custkey % 8 <> 0 AND c_custkey <= 32767")
def v20(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 8 == 0, "XX-1").otherwise(F.concat(F.lit("ST-"), "c_custkey")).alias("id"))
    no = F.nullif(F.regexp_extract("id", r"^ST-(\d+)$", 1), F.lit("")).try_cast("long")
    return c.select("c_custkey", no.alias("no")).where("no is not null and no <= 32767")


@query("v21_row_drop_guard", "SELECT count(*)::BIGINT AS before, count(*) FILTER (WHERE c_acctbal >= 0)::BIGINT AS after, 1 - count(*) FILTER (WHERE c_acctbal >= 0) / count(*) <= 0.05 AS pass FROM customer")
def v21(spark, sf):
    n = table(spark, sf, "customer").agg(F.count("*").alias("before"), F.count_if(F.col("c_acctbal") >= 0).alias("after"))
    return n.withColumn("pass", 1 - F.col("after") / F.col("before") <= 0.05)


@query("v22_training_window", f"WITH {FUTURE_SQL} SELECT * FROM fut WHERE tick >= 1704499200 AND tick <= 1705363200 - 43200")
def v22(spark, sf):
    return future_counts(trips(spark, sf)).where((F.col("tick") >= 1704499200) & (F.col("tick") <= 1705363200 - 43200))


@query("v25_current_events", "SELECT o_orderkey, o_orderdate::DATE AS since, (o_orderdate::DATE + (o_orderkey % 90)::INT) AS until FROM orders WHERE o_orderdate::DATE + (o_orderkey % 90)::INT >= DATE '1998-06-01' AND o_orderdate::DATE < DATE '2000-06-01'")
def v25(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("since"))
    o = o.withColumn("until", F.date_add("since", (F.col("o_orderkey") % 90).cast("int")))
    return o.where("until >= date '1998-06-01' and since < date '2000-06-01'")


@query("v26_constraint_report", """SELECT 'order_customer_fk' AS rule, (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 100 <> 1))::BIGINT AS violations
UNION ALL SELECT 'quantity_range', (SELECT count(*) FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 49)) UNION ALL SELECT 'status_domain', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')) UNION ALL SELECT 'line_key', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1))""")
def v26(spark, sf):
    o, l, c = (table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    fk = o.join(c.where("c_custkey % 100 <> 1").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    parts = {
        "order_customer_fk": fk,
        "quantity_range": l.where(~F.col("l_quantity").between(1, 49)),
        "status_domain": o.where(~F.col("o_orderstatus").isin("O", "F")),
        "line_key": l.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
    }
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.unionByName(row)
    return out

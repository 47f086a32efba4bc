"""Declarative column rules: each value gets a verdict, policies repair or reject, and one pass gives clean rows and quarantine.

A rule is a dict: name, types (tried in order), required, min/max or enum, on_missing, on_outlier, default.
Policies: keep_null, set_null, fill_zero, fill_default, clip_to_range, drop_row, fail_batch. A value that
can't be cast is a type error and follows on_outlier, but no fill applies to it: it becomes null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULTS = {("required", "missing"): "drop_row", ("required", "outlier"): "drop_row", ("optional", "missing"): "keep_null", ("optional", "outlier"): "set_null"}
SQL_TYPE = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}
ISSUE = "struct<column: string, kind: string, required: boolean, action: string>"


def first_cast(c, types: list[str]):
    """The value under the first type that accepts it, as the widest of the types."""
    wide = "string" if "str" in types else "double" if "float" in types else SQL_TYPE[types[0]]
    return F.coalesce(*[c.try_cast(SQL_TYPE[t]).cast(wide) for t in types])


def verdict(c, rule: dict):
    """struct(value, kind): kind is null, missing, type or outlier."""
    return judged_value(F.struct(c.alias("raw"), first_cast(c, rule["types"]).alias("value")), rule)


def judged_value(x, rule: dict):
    """verdict() of a struct of the raw and the cast value."""
    raw, value = x["raw"], x["value"]
    missing = raw.isNull() | (F.trim(raw.cast("string")) == "")
    outside = F.lit(False)
    if "enum" in rule:
        outside = ~value.isin(rule["enum"])
    if "min" in rule:
        outside = outside | (value < rule["min"])
    if "max" in rule:
        outside = outside | (value > rule["max"])
    kind = F.when(missing, "missing").when(value.isNull(), "type").when(outside, "outlier")
    return F.struct(value.alias("value"), kind.alias("kind"))


def policy(rule: dict, kind: str) -> str:
    """The rule's own policy, else the default of required or optional columns."""
    side = "missing" if kind == "missing" else "outlier"
    return rule.get(f"on_{side}") or DEFAULTS["required" if rule.get("required") else "optional", side]


def repaired(v, rule: dict):
    """The value after its policy."""
    value, kind = v["value"], v["kind"]
    null = F.lit(None)

    def apply(k: str):
        p = policy(rule, k)
        if k == "type":
            return null
        if p == "fill_zero":
            return F.lit(0)
        if p == "fill_default":
            return F.lit(rule.get("default"))
        if p == "clip_to_range" and k == "outlier" and "min" in rule and "max" in rule:
            return F.least(F.greatest(value, F.lit(rule["min"])), F.lit(rule["max"]))
        return value if p == "keep_null" and k == "missing" else null

    out = F.when(kind.isNull(), value)
    for k in ("missing", "type", "outlier"):
        out = out.when(kind == k, apply(k))
    return out


def validate(df: DataFrame, rules: list[dict], max_issues: int | None = None) -> DataFrame:
    """df with repaired columns, `_issues` and `_row_status` (ok, repaired, dropped, failed), in one pass."""
    names = [r["name"] for r in rules]

    def judged(v):
        issues = []
        for r in rules:
            kind = v[r["name"]]["kind"]
            action = F.when(kind == "missing", policy(r, "missing")).otherwise(policy(r, "outlier"))
            issues.append(F.when(kind.isNotNull(), F.struct(F.lit(r["name"]).alias("column"), kind.alias("kind"), F.lit(bool(r.get("required"))).alias("required"), action.alias("action"))))
        fixed = [repaired(v[r["name"]], r).alias(r["name"]) for r in rules]
        return F.struct(*fixed, F.array_compact(F.array(*issues)).cast(f"array<{ISSUE}>").alias("_issues"))

    def decided(x):
        failed = F.exists(x["_issues"], lambda i: i["action"] == "fail_batch")
        dropped = F.exists(x["_issues"], lambda i: i["action"] == "drop_row")
        if max_issues is not None:
            dropped = dropped | (F.size(x["_issues"]) > max_issues)
        status = F.when(failed, "failed").when(dropped, "dropped").when(F.size(x["_issues"]) > 0, "repaired").otherwise("ok")
        return F.struct(*[x[n].alias(n) for n in names], x["_issues"].alias("_issues"), status.alias("_row_status"))

    # one-element arrays bind each step's value, so that filters pushed through do not multiply the expressions, and no value is cast twice
    cast = F.array(F.struct(*[F.struct(F.col(r["name"]).alias("raw"), first_cast(F.col(r["name"]), r["types"]).alias("value")).alias(r["name"]) for r in rules]))
    verdicts = F.transform(cast, lambda v: F.struct(*[judged_value(v[r["name"]], r).alias(r["name"]) for r in rules]))
    out = df.withColumn("_x", F.transform(F.transform(verdicts, judged), decided)[0])
    return out.withColumns({n: F.col("_x")[n] for n in [*names, "_issues", "_row_status"]}).drop("_x")


def clean(validated: DataFrame) -> DataFrame:
    return validated.where("_row_status in ('ok', 'repaired')").drop("_issues")


def quarantine(validated: DataFrame) -> DataFrame:
    return validated.where("_row_status in ('dropped', 'failed')")


def issue_counts(validated: DataFrame) -> DataFrame:
    """column, kind, action and how many. Rows with the same issues are counted as one list first, so few lists are unpacked."""
    lists = validated.groupBy("_issues").agg(F.count("*").alias("_n"))
    return lists.select(F.explode("_issues").alias("i"), "_n").groupBy("i.column", "i.kind", "i.action").agg(F.sum("_n").alias("n"))


def missing_ratio(planned, fetched, parts_missing, parts_got):
    """The share that is missing: by rows where the source told how many there are, else by parts."""
    by_parts = F.coalesce(F.try_divide(parts_missing, parts_missing + parts_got), F.lit(0.0))
    by_rows = F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(fetched, planned), F.lit(1.0)))
    return F.when(planned.isNotNull(), by_rows).otherwise(by_parts)


def overfetch_ratio(planned, fetched):
    """How far the rows go beyond what the source told; 0 where it told nothing."""
    return F.when(planned > 0, F.greatest(F.lit(0.0), fetched / planned - 1)).otherwise(F.lit(0.0))


def gates(validated: DataFrame, max_drop: float = 0.5, allow_empty: bool = False, plan: DataFrame | None = None, max_missing: float = 0.1, max_over: float = 0.05) -> DataFrame:
    """One row: counts, drop ratio and whether the batch may be written.

    plan (planned, parts_missing, parts_got; one row): adds `missing_ratio` and `over_ratio`, and their gates to `pass`."""
    is_ = F.col("_row_status")
    counts = {"kept": is_.isin("ok", "repaired"), "repaired": is_ == "repaired", "dropped": is_ == "dropped", "failed": is_ == "failed"}
    out = validated.agg(F.count("*").alias("fetched"), *[F.count_if(when).alias(name) for name, when in counts.items()])
    ratio = F.try_divide("dropped", "fetched")
    ok = (F.col("failed") == 0) & (F.coalesce(ratio, F.lit(0.0)) <= max_drop) & ((F.col("fetched") > 0) | F.lit(allow_empty))
    if plan is None:
        return out.withColumns({"drop_ratio": F.bround(ratio, 6), "pass": ok})
    out = out.join(F.broadcast(plan.limit(1)))  # one row
    missing = missing_ratio(F.col("planned"), F.col("fetched"), F.col("parts_missing"), F.col("parts_got"))
    over = overfetch_ratio(F.col("planned"), F.col("fetched"))
    out = out.withColumns({"_missing": missing, "_over": over})
    ok = ok & (F.col("_missing") <= max_missing) & (F.col("_over") <= max_over)
    out = out.withColumns({"drop_ratio": F.bround(ratio, 6), "missing_ratio": F.bround("_missing", 6), "over_ratio": F.bround("_over", 6), "pass": ok})
    return out.drop("_missing", "_over", "planned", "parts_missing", "parts_got")


def panel_gaps(panel: DataFrame, stations: DataFrame, hours: int = 12, key: str = "station_id", base: str = "base_s") -> DataFrame:
    """Per station of the list or the panel (key, horizon, base): missing, extra and repeated horizons, and other_base, the rows
    whose base is not the panel's most frequent one (ties: the newest). All zero for a whole panel."""
    usual = panel.groupBy(base).agg(F.count("*").alias("_n")).agg(F.max(F.struct("_n", base)).alias("x")).select(F.col(f"x.{base}").alias("_base"))
    full = stations.select(key).distinct().withColumn("horizon", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(hours).cast("long"))))
    other = F.count_if(~F.col(base).eqNullSafe(F.col("_base")))
    got = panel.join(F.broadcast(usual)).groupBy(key, "horizon").agg(F.count("*").alias("_n"), other.alias("_other"))  # one row is broadcast
    both = full.withColumn("_f", F.lit(True)).join(got, [key, "horizon"], "full")
    none = F.lit(0).cast("long")
    return both.groupBy(key).agg(
        F.count_if(F.col("_n").isNull()).alias("missing"),
        F.count_if(F.col("_f").isNull()).alias("extra"),
        F.coalesce(F.sum(F.greatest(F.col("_n") - 1, none)), none).alias("repeated"),
        F.coalesce(F.sum("_other"), none).alias("other_base"),
    )

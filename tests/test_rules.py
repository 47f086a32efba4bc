"""Column rules: how often a plan casts a value, how rows are dealt, and counts of issues."""

from tidewheel.operators import rules as Q
from tidewheel.plans import checks

ROWS = [("5", "a"), ("bad", "z"), (None, "z"), ("-1", " "), ("5", "a"), ("bad", "z")]


def test_issue_counts_cast_once_and_deal_rows(spark, sf):
    df = checks.v10(spark, sf)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("cast(") < 60
    assert checks.checked(spark, sf).rdd.getNumPartitions() > 1  # one small file


def test_issue_counts_of_repeated_lists(spark):
    rules = [{"name": "n", "types": ["int"], "required": True, "min": 0}, {"name": "s", "types": ["str"], "enum": ["a"], "on_missing": "fill_default", "default": "-"}]
    got = {(r.column, r.kind, r.action): r.n for r in Q.issue_counts(Q.validate(spark.createDataFrame(ROWS, "n string, s string"), rules)).collect()}
    assert got == {("n", "type", "drop_row"): 2, ("n", "missing", "drop_row"): 1, ("n", "outlier", "drop_row"): 1, ("s", "outlier", "set_null"): 3, ("s", "missing", "fill_default"): 1}

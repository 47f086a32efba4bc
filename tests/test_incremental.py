"""Runs from a watermark, signatures and inventories over small tables."""

import pytest
from pyspark.sql import functions as F

from tidewheel.plans import streams
from tidewheel.sources import files, incremental

DAY = 86400


def counted(trips):
    return trips.groupBy("station_id", (F.floor(F.col("start_s") / 3600) * 3600).alias("tick")).agg(F.count("*").alias("n"))


def table(spark, rows):
    return spark.createDataFrame(rows, "station_id long, start_s long")


def named(df, key):
    """The files that each partition's rows come from."""
    out = {}
    for k, path in df.select(key, "_metadata.file_path").distinct().collect():
        out.setdefault(k, set()).add(path)
    return out


def test_runs_from_the_watermark(spark):
    path = files.work_folder(spark, "runs")
    early = [(1, d * DAY + h * 3600) for d in range(10, 14) for h in range(24)]
    late = [(1, 12 * DAY + 7200), (1, 13 * DAY), (2, 14 * DAY + 5), (1, 14 * DAY)]
    build = lambda rows: lambda since: counted(table(spark, rows) if since is None else table(spark, rows).where(F.col("start_s") >= since))
    args = {"lookback": DAY, "max_age": DAY, "order": ("station_id", "tick")}
    assert incremental.run(spark, path, build(early), 14 * DAY, **args) == ("full", 96)
    assert incremental.run(spark, path, build(early + late), 15 * DAY, **args) == ("skipped", 0)
    before = named(spark.read.parquet(path), "date")
    assert incremental.run(spark, path, build(early + late), 15 * DAY + 1, **args)[0] == "incremental"
    got = spark.read.parquet(path)
    assert sorted(map(tuple, got.select("station_id", "tick", "n").collect())) == sorted(map(tuple, counted(table(spark, early + late)).collect()))
    after = named(got, "date")
    assert sorted(d for d in before if before[d] == after[d]) == [10, 11]  # the days before the lookback are not touched
    assert incremental.control(spark, path) == {"newest": 14 * DAY, "updated_at": 15 * DAY + 1}
    assert incremental.run(spark, path, build([]), 20 * DAY, **args) == ("empty", 0)
    assert incremental.control(spark, path)["updated_at"] == 15 * DAY + 1


def test_flat_files_stop_a_run(spark):
    path = files.work_folder(spark, "flat")
    build = lambda since: counted(table(spark, [(1, 5)]))
    incremental.run(spark, path, build, 0, DAY, 0)
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).createNewFile(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/old.parquet"))
    with pytest.raises(ValueError, match="old.parquet"):
        incremental.run(spark, path, build, 10, DAY, 0)


def test_three_runs_of_the_query(spark, sf):
    outcomes = streams.incremental_counts(spark, sf, files.work_folder(spark, "three"))
    assert [o for o, _ in outcomes] == ["full", "incremental", "skipped"]


def test_a_run_without_success_does_not_count(spark):
    path = files.work_folder(spark, "state")
    assert incremental.read_state(spark, path) is None
    incremental.write_state(spark.range(3), path)
    spark.range(9).write.parquet(f"{path}/run=2/half")
    assert incremental.read_state(spark, path).count() == 3
    incremental.write_state(spark.range(5), path)
    assert incremental.read_state(spark, path).count() == 5


def test_signatures_see_rows_not_their_order(spark):
    rows = [("a", 1, None), ("a", None, 1), ("a", 2, 2), ("a", 2, 2), ("b", 0, 0), ("c", 1, None), ("d", None, 1), ("e", 2, 2), ("e", 2, 2), ("e", 2, 2)]
    sign = lambda r, n: {x.k: x.signature for x in incremental.content_signature(spark.createDataFrame(r, "k string, x int, y int").repartition(n), ["k"], ["x", "y"]).collect()}
    one = sign(rows, 3)
    assert one == sign(rows[::-1], 2)
    assert len(set(one.values())) == len(one)
    assert sign(rows[:3] + rows[4:], 2)["a"] != one["a"]


def test_only_changed_keys_are_written(spark):
    path = files.work_folder(spark, "changed")
    make = lambda rows: spark.createDataFrame(rows, "k long, v long")
    state = lambda df: {r.k: r.state for r in df.collect()}
    assert state(incremental.write_changed(make([(1, 1), (1, 2), (2, 5), (3, 7)]), path, "k")) == {1: "written", 2: "written", 3: "written"}
    files_of = lambda: named(spark.read.parquet(path), "k")
    before = files_of()
    assert state(incremental.write_changed(make([(1, 2), (1, 1), (2, 6), (4, 0)]), path, "k")) == {1: "skipped", 2: "written", 3: "absent", 4: "written"}
    after = files_of()
    assert before[1] == after[1] and before[3] == after[3] and before[2] != after[2]
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect())) == [(1, 1), (1, 2), (2, 6), (3, 7), (4, 0)]
    assert state(incremental.write_changed(make([(1, 2), (1, 1), (2, 6), (4, 0)]), path, "k")) == {1: "skipped", 2: "skipped", 3: "absent", 4: "skipped"}


def test_inventory_refuses_changed_bytes(spark):
    path = files.work_folder(spark, "inventory")
    make = lambda rows: spark.createDataFrame(rows, "k string, sha string, bytes long")
    merge = lambda rows: {r.k: (r.sha, r.state) for r in incremental.merge_inventory(make(rows), path, ["k"], "sha").collect()}
    assert merge([("a", "1", 1), ("b", "2", 2), (None, "n", 0)]) == {"a": ("1", "new"), "b": ("2", "new"), None: ("n", "new")}
    assert merge([("a", "9", 9), ("c", "3", 3), ("c", "3", 3), ("d", "4", 4), ("d", "5", 4), (None, "n", 0)]) == {"a": ("1", "rejected"), "b": ("2", "kept"), "c": ("3", "new"), "d": ("4", "rejected"), None: ("n", "same")}
    assert sorted((r.k, r.sha) for r in incremental.read_state(spark, f"{path}-rejected").collect()) == [("a", "9"), ("d", "4")]
    assert merge([("a", "1", 1)]) == {"a": ("1", "same"), "b": ("2", "kept"), "c": ("3", "kept"), None: ("n", "kept")}


def test_many_keys_lie_in_few_folders(spark):
    """Folders do not grow with the keys; absent keys keep their rows where their folder is written anew, and equal folders stay."""
    path = files.work_folder(spark, "many")
    rows = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.col("id").alias("v"))
    incremental.write_changed(rows, path, "k")
    read = lambda: spark.read.parquet(path)
    assert 1 < len({f.rsplit("/", 2)[1] for (f,) in read().select("_metadata.file_path").distinct().collect()}) <= 256
    before = named(read(), "k")
    second = rows.where("k % 7 <> 0").withColumn("v", F.when(F.col("k") == 5, -1).otherwise(F.col("v")))
    for _ in range(2):
        got = {r.k: (r.n, r.state) for r in incremental.write_changed(second, path, "k").collect()}
        assert sum(s == "absent" for _, s in got.values()) == 143 and all(n == 3 for n, _ in got.values())
        want = sorted((i % 1000, -1 if i % 1000 == 5 else i) for i in range(3000))
        assert sorted(map(tuple, read().select("k", "v").collect())) == want
    assert got[5] == (3, "skipped")
    after = named(read(), "k")
    assert before[5] != after[5] and sum(before[k] != after[k] for k in before) < 30

"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken target / source size times. The whole part is taken as it
is; the fractional parts are made integral by the pivotal method: two documents meet, and mass (words) is
moved between them at random, keeping its sum and each document's expectation, until one of them is
integral; the other one goes on. The number of words taken per source therefore differs from its
target by less than one document. Groups of about `FAN_IN` documents are folded in one expression, and
the one unfinished document of each group goes to the next level of a reduction tree, so no group is
ever larger and a source of any size only deepens the tree by a level. Random numbers are hashes of
the documents met, so reruns agree. DataFrame functions only.

Groups are drawn by the hash of a document and the number of its repetition, so repeated rows part as well.

Defined cases: null texts have size 0; documents of size 0 are never taken (taken = 0); the null source
is a source and comes last; null doc_ids are documents like others; repeated rows are documents of their own;
texts of any length are taken whole; other columns of the input, whatever their names, are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import count_words, in_order, join_hot, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
FAN_IN = 32
#: Source tables beyond this many rows are joined by a shuffle.
BROADCAST_ROWS = 50_000


def _named(source):
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: source, source_size, n_docs, weight, target (words).

    Water-filling: the words are shared by weight; sources above their cap are set to it, and the excess is shared
    among the others anew until none is above. A pass is one sum over the sources, which are placed in
    order by range partitions, so no task holds them all."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = in_order(per.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "mixing-sources").drop("_last")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("position", F.lit(len(weights))) + 1).cast("int"))
    per = stored(per.withColumns({"weight": w, "_cap": F.col("source_size") * F.lit(cap)}).drop("position"), "mixing-caps")
    words = per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, capped = 0.0, -1
    while True:
        full = F.col("_cap") < F.lit(level) * F.col("weight")
        caps, rest, n = per.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if n == capped or not rest:  # none more is above; without rest all are at their caps
            break
        level, capped = max(level, (words - (caps or 0.0)) / rest), n
    return per.select("source", "source_size", "n_docs", "weight", F.least("_cap", F.lit(level) * F.col("weight")).alias("target"))


def _uniform(*cols):
    """A number in [0, 1) from the columns' hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _meet(a, b, level: int):
    """What becomes of two units: struct(done, open). Moves words from one to the other; the sum and the expectations stay."""
    to_a = F.least(a["size"] * (1 - a["f"]), b["size"] * b["f"])
    to_b = F.least(a["size"] * a["f"], b["size"] * (1 - b["f"]))
    up = _uniform(F.lit(level), *[x[c] for x in (a, b) for c in _FIELDS[:4]]) * (to_a + to_b) < to_b
    fill_a = a["size"] * (1 - a["f"]) <= b["size"] * b["f"]  # a gains: a is full before b is empty
    fill_b = b["size"] * (1 - b["f"]) <= a["size"] * a["f"]

    def unit(x, f):
        return F.struct(*[x[c].alias(c) for c in _FIELDS], F.least(F.lit(1.0), F.greatest(F.lit(0.0), f)).alias("f"))

    one, zero = F.lit(1.0), F.lit(0.0)
    pair = lambda done, left: F.struct(done.alias("done"), left.alias("open"))
    return (
        F.when((a["f"] <= 0) | (a["f"] >= 1), pair(unit(a, a["f"]), unit(b, b["f"])))
        .when((b["f"] <= 0) | (b["f"] >= 1), pair(unit(b, b["f"]), unit(a, a["f"])))
        .when(up & fill_a, pair(unit(a, one), unit(b, b["f"] - to_a / b["size"])))
        .when(up, pair(unit(b, zero), unit(a, a["f"] + to_a / a["size"])))
        .when(fill_b, pair(unit(b, one), unit(a, a["f"] - to_b / a["size"])))
        .otherwise(pair(unit(a, zero), unit(b, b["f"] + to_b / b["size"])))
    )


_UNIT = "struct<doc_id: bigint, text_key: bigint, copy: bigint, size: bigint, whole: double, f: double>"
_FIELDS = ("doc_id", "text_key", "copy", "size", "whole")


def _fold(units, level: int):
    """Folds an array of units: struct(open, done)."""
    start = F.struct(F.get(units, F.lit(0)).cast(_UNIT).alias("open"), F.array().cast(f"array<{_UNIT}>").alias("done"))

    def step(acc, x):
        met = _meet(acc["open"], x, level)
        return F.transform(F.array(met), lambda m: F.struct(m["open"].cast(_UNIT).alias("open"), F.concat(acc["done"], F.array(m["done"].cast(_UNIT))).alias("done")))[0]

    return F.aggregate(F.slice(units, F.lit(2), F.size(units)), start, step)


def round_copies(units: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """units (source, n_docs, doc_id, text_key, copy, size, whole, f in [0, 1]) with f made 0 or 1: source and the unit's fields."""
    most = units.agg(F.max("n_docs")).first()[0] or 0
    groups = max(1, -(-most // fan_in))
    n_groups = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(fan_in))).cast("long")
    left = units.select("source", F.pmod(F.xxhash64(*_FIELDS[:4]), n_groups).alias("g"), F.struct(*_FIELDS, "f").cast(_UNIT).alias("u"))
    finished, level = [], 0
    while True:
        lists = left.groupBy("source", "g").agg(F.array_sort(F.collect_list("u")).alias("us"))
        folded = stored(lists.select("source", "g", _fold(F.col("us"), level).alias("r")), f"mixing-level-{level}")
        finished.append(folded.select("source", F.explode("r.done").alias("u")))
        if groups == 1:
            last = F.col("r.open")
            f = F.when(_uniform(F.lit(-1), *[last[c] for c in _FIELDS[:4]]) < last["f"], 1.0).otherwise(0.0)
            finished.append(folded.select("source", F.struct(*[last[c].alias(c) for c in _FIELDS], f.alias("f")).alias("u")))
            break
        left = folded.select("source", F.floor(F.col("g") / F.lit(fan_in)).alias("g"), F.col("r.open").alias("u"))
        groups, level = -(-groups // fan_in), level + 1
    return reduce(DataFrame.unionByName, finished).select("source", "u.*")


#: Repeated rows are numbered in two steps, so no array is longer than this.
RUN = 1 << 16


def numbered(sized: DataFrame) -> DataFrame:
    """Rows that repeat (source, doc_id, text_key, size) get numbers of their own (copy): counted first, then told apart."""
    per = sized.groupBy("source", "doc_id", "text_key", "size").agg(F.count("*").alias("_n"))
    runs = per.withColumn("_run", F.explode(F.expr(f"sequence(0L, (_n - 1) div {RUN})")))
    copy = F.explode(F.expr(f"sequence(_run * {RUN}, least(_n, (_run + 1) * {RUN}) - 1)")).alias("copy")
    return runs.select("source", "doc_id", "text_key", "size", copy)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per document: doc_id, text_key (hash of the text), source, size, source_size, target, copies, taken (copies * size)."""
    sized = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", count_words(F.col("text")).alias("size"))
    sized = stored(sized, "mixing-sizes")
    per = stored(targets(sized, weights, share, cap).withColumn("_k", _named(F.col("source"))), "mixing-targets")
    few = per.count() <= BROADCAST_ROWS

    def with_targets(rows):
        rows = rows.withColumn("_k", _named(F.col("source"))).drop("source")
        return (rows.join(F.broadcast(per), "_k") if few else join_hot(rows, per, "_k")).drop("_k")

    ratio = F.col("target") / F.col("source_size")
    whole = F.least(F.floor(ratio + F.lit(1e-12)).cast("double"), F.floor(F.lit(cap)))
    part = with_targets(numbered(sized.where("size > 0"))).withColumn("whole", whole).withColumn("f", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio - F.col("whole"))))
    done = round_copies(part.select("source", "n_docs", *_FIELDS, "f"))
    copies = done.select("source", "doc_id", "text_key", "size", (F.col("whole") + F.col("f")).cast("long").alias("copies"))
    none = sized.where("size = 0").select("source", "doc_id", "text_key", "size", F.lit(0).cast("long").alias("copies"))
    return with_targets(copies.unionByName(none)).select("doc_id", "text_key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op8_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")

"""Connected components of links between documents, as joins of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, stored


def _nearest(v, round_: int):
    """A vertex with its rank of the round: ranks are drawn anew each round, so no order of ids is slow."""
    return F.struct(F.xxhash64(v, F.lit(round_)).alias("rank"), v.alias("id"))


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """links (a, b: long) -> (v, root): root is the smallest vertex that v reaches.

    Each round merges every vertex into the one of least rank within two links and renames the links; those
    inside a merged vertex leave. With random ranks a constant share of the vertices is expected to leave a
    round, so rounds are logarithmic for any shape, long chains too. It ends when no link is left;
    beyond the safety bound of rounds it raises. Tables are written to the shared folder between rounds."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct(), "links")
    labels = None
    for k in range(rounds):
        near = both.groupBy("a").agg(F.min(_nearest(F.col("b"), k)).alias("_near"))
        near = near.select(F.col("a").alias("b"), F.least("_near", _nearest(F.col("a"), k)).alias("_near"))
        far = both.join(near, "b").groupBy("a").agg(F.min("_near").alias("_far"))
        into = stored(far.select(F.col("a").alias("v"), F.col("_far.id").alias("root")), "merged")
        if labels is None:
            labels = into
        else:
            step = into.select(F.col("v").alias("root"), F.col("root").alias("_next"))
            labels = stored(join_hot(labels, step, "root", "left").select("v", F.coalesce("_next", "root").alias("root")), "labels")
        for end in ("a", "b"):
            both = both.join(into.select(F.col("v").alias(end), F.col("root").alias(f"_{end}")), end)
        both = stored(both.select(F.col("_a").alias("a"), F.col("_b").alias("b")).where("a <> b").distinct(), "links")
        if not both.limit(1).count():
            break
    else:
        raise RuntimeError(f"components: links are left after {rounds} rounds")
    least = labels.groupBy("root").agg(F.min("v").alias("_least"))
    return stored(join_hot(labels, least, "root").select("v", F.col("_least").alias("root")), "labels")

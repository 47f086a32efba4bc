"""Sharding by minimax contiguous partition: the smallest capacity under which ordered groups fill the shards.

Groups of equal texts are atomic and ordered by the 63-bit hash of their text. The smallest capacity
for which a greedy fill needs no more than the given shards is found by binary search; the order is cut
within that capacity, between the ends of the greedy fills from the left and from the right, as near to
even sizes as it allows. The greedy check runs over cells, ranges of the hash with the
sum of their sizes: a bounded number at first, then only cells in which a cut can still fall are
counted again at a finer grain, until every such cell is a single group. What the driver holds is thus
bounded by the number of cells and not by the table, and the result is that of the search over all
groups. Law: `bytes`. DataFrame functions only.

Defined cases: null texts count as empty ones; equal texts, also repeated rows, share a shard; with
fewer groups than shards the last shards stay empty; a group larger than the even share fixes the
capacity; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_order, stored, utf8_length

SHARDS, PER_ROW = 40, 16
KEY_BITS, FIRST_BITS, STEP_BITS = 63, 12, 6


class Cells:
    """Cells in key order: (first key, depth in bits, size, groups)."""

    def __init__(self, rows):
        self.rows = sorted(rows)
        self.sums = [0, *accumulate(r[2] for r in self.rows)]

    def fill(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy: the cell at which each shard ends (exclusive); None if the shards don't hold all cells."""
        at, cuts = 0, []
        for _ in range(shards):
            at = bisect_right(self.sums, self.sums[at] + capacity) - 1
            cuts.append(at)
            if at == len(self.rows):
                return cuts
        return None

    def smallest(self, shards: int) -> int:
        total = self.sums[-1]
        low, high = max([-(-total // shards), *(r[2] for r in self.rows if r[3] == 1)]), max(1, total)
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fill(mid, shards) is not None else (mid + 1, high)
        return low

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """The cells at which the shards end: within the capacity, as near to even sizes as it allows.

        The greedy fill from the left bounds a cut from above, the one from the right from below; a plain
        greedy cut would leave the last shard what the others could not take."""
        end, total = len(self.rows), self.sums[-1]
        least = [end]
        for _ in range(shards - 1):
            least.append(bisect_left(self.sums, self.sums[least[-1]] - capacity))
        at, out = 0, []
        for k, low in enumerate(reversed(least), start=1):
            goal = k * total / shards
            near = bisect_left(self.sums, goal)
            if near and goal - self.sums[near - 1] < self.sums[min(near, end)] - goal:
                near -= 1
            most = bisect_right(self.sums, self.sums[at] + capacity) - 1
            at = min(max(near, low, at), most, end)
            out.append(at)
        return out

    def open_cells(self, shards: int) -> list[tuple[int, int]]:
        """Cells of several groups in which a cut of the true search can fall.

        The true capacity lies between the even share (or the largest single group) and the one found over
        whole cells. Filling from the left with the least capacity and whole cells gives the earliest place of a
        cut, with the largest capacity and divisible cells the latest."""
        large = [r[:2] for r in self.rows if r[3] > 1 and 8 * shards * r[2] > self.sums[-1]]
        if large:  # these first, at most 8 * shards: they would make the bounds wide
            return large
        low = max([-(-self.sums[-1] // shards), *(r[2] for r in self.rows if r[3] == 1)])
        high, early, late, out = self.smallest(shards), 0, 0, set()
        for _ in range(shards):
            early = max(early, bisect_right(self.sums, self.sums[early] + low) - 1)
            late = min(self.sums[-1], late + high)
            last = min(len(self.rows) - 1, bisect_right(self.sums, late) - 1)
            out.update(i for i in range(early, last + 1) if self.rows[i][3] > 1)
        return [self.rows[i][:2] for i in sorted(out)]


def count_cells(groups: DataFrame, depth: int) -> list[tuple]:
    cell = F.shiftright("key", KEY_BITS - depth)
    found = groups.groupBy(cell.alias("cell")).agg(F.sum("size"), F.count("*")).collect()
    return [(r[0] << (KEY_BITS - depth), depth, r[1], r[2]) for r in found]


def cut_keys(groups: DataFrame, shards: int = SHARDS) -> tuple[list[int], int]:
    """First keys of the shards 1.. and the capacity; groups: key, size (one row per key)."""
    cells = Cells(count_cells(groups, FIRST_BITS))
    while cells.rows and (todo := cells.open_cells(shards)):
        by_depth: dict[int, list[int]] = {}
        for first, depth in todo:
            by_depth.setdefault(depth, []).append(first)
        kept = [r for r in cells.rows if r[:2] not in set(todo)]
        for depth, firsts in by_depth.items():
            wanted = groups.sparkSession.createDataFrame([(f >> (KEY_BITS - depth),) for f in firsts], "_cell long")
            finer = groups.join(F.broadcast(wanted), F.shiftright("key", KEY_BITS - depth) == F.col("_cell"), "left_semi")
            kept += count_cells(finer, min(KEY_BITS, depth + STEP_BITS))
        cells = Cells(kept)
    if not cells.rows:
        return [], 0
    capacity = cells.smallest(shards)
    cuts = cells.cuts(capacity, shards)
    return [cells.rows[c][0] if c < len(cells.rows) else 1 << KEY_BITS for c in cuts[:-1]], capacity


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (utf8_length(F.col("text")) + PER_ROW).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).bitwiseAND(F.lit((1 << KEY_BITS) - 1)).alias("key"),
    )
    placed = stored(in_order(rows, ["key", "doc_id", "text_crc32"], "shard-order"), "shard-rows")
    groups = stored(placed.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    firsts, _ = cut_keys(groups, shards)
    inner = [f for f in firsts if f < 1 << KEY_BITS]
    shard = sum((F.when(F.col("key") >= F.lit(f), 1).otherwise(0) for f in inner), F.lit(0)).cast("int")
    out = placed.withColumn("shard", shard)
    start = out.groupBy("shard").agg(F.min("position").alias("_first"))
    return out.join(F.broadcast(start), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("position") - F.col("_first")).alias("slot"))


def op10_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

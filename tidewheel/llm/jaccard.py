"""N-gram Jaccard join by T-occurrence search over inverted lists (DivideSkip).

A document's set holds the distinct 5-word shingles of its lower-cased words. Documents with equal sets
are one class. Two sets a, b link when |a n b| / |a u b| >= 0.75, so a needs at least T = ceil(0.75 |a|)
of its shingles in b's set.

1. Tasks turn blocks of texts into shingle hashes and deal them by hash into buckets. A bucket knows for
   each of its shingles the number of classes that hold it. Shingles of a single class can't be shared
   and are dropped; a class that is left with fewer than T shingles has no link.
2. The lists of a class's shingles are ordered from short to long by that number. T - 1 long lists alone
   can't reach T, so every link shows in the remaining, short ones, which are merged; shared
   passages and frequent phrases have long lists and are never merged.
3. In each short list one class, the pivot, is the query and the others are its candidates. The components of
   these links only give an order in which near copies lie side by side.
4. Classes in that order are cut into blocks, and of every two blocks that a short list has entries in, one is
   searched for against the inverted lists of the other: all links are found, each once. DivideSkip merges a
   query's shorter lists, keeps candidates with T - L occurrences and probes the L longest lists by binary
   search. Lists in a task's memory are merged by counting entries per candidate instead of with a heap.
5. Links are counted per class (`n_links`), and those between components of step 3 complete the components.

Work follows the entries of short lists that meet. Where texts are made of few common passages alone, short lists
are long too, and pairs that share one of their rarest passages are candidates: their number then grows faster
than the texts', as the number of links does.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; texts
of fewer than five words have one shingle, the whole sequence; equal and repeated rows are one class; null
doc_ids come after all others and are null in the result;
very long texts weigh more in their block; other columns of the input, whatever their names, are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import in_order, join_hot, partitions, stored
from .tokens import Block, blocks, mix, record_group, run_starts, split_block

WORDS = 5
#: Bits of a shingle kept beside its bucket's number.
LOW_BITS = 40
_ITEM = "long"


def shingles(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a block's texts, sorted per text, and the number per text."""
    w = block.hashes[block.which]
    n = block.sizes
    mult = np.uint64(0x9E3779B97F4A7C15)
    own = np.repeat(np.arange(len(n), dtype=np.int32), n)
    left = np.repeat(block.starts[1:].astype(np.int32), n) - np.arange(len(w), dtype=np.int32)
    full = np.flatnonzero(left >= WORDS)
    del left
    h = np.full(len(full), np.uint64(WORDS))
    for k in range(WORDS):
        h = h * mult + w[full + k]
    docs = own[full]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        few = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            x = np.uint64(n[d])
            with np.errstate(over="ignore"):
                for v in w[block.starts[d] : block.starts[d + 1]]:
                    x = x * mult + v
            few[i] = x
        h, docs = np.concatenate([h, few]), np.concatenate([docs, short])
    h = mix(h)
    order = np.lexsort((h, docs))
    h, docs = h[order], docs[order]
    first = run_starts(docs, h)
    return h[first], np.bincount(docs[first], minlength=len(n))


def signatures(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit name of each text's set (signed): equal sets, equal names."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(0x632BE59BD9B4E019)))])
    ends = np.cumsum(counts)
    return mix((sums[ends] - sums[ends - counts]) + counts.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


_DEALT = "bucket int, low binary, held binary, sig binary, n binary, doc_id binary"


def _deal(buckets: int):
    """Blocks of texts -> per bucket the low bits of its shingles with their texts; per block its texts' names and sizes."""

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, rows in enumerate(blocks(batches)):
            block = split_block(rows)
            h, counts = shingles(block)
            sig = signatures(h, counts)
            ids, keys = (np.ascontiguousarray(rows.column(c).to_numpy(), np.int64) for c in ("doc_id", "text_key"))
            yield pa.RecordBatch.from_pylist([{"bucket": -1 - record_group(part, k, buckets), "low": keys.tobytes(), "held": None, "sig": sig.tobytes(), "n": counts.astype(np.int32).tobytes(), "doc_id": ids.tobytes()}], schema=schema)
            if not len(h):
                continue
            _, one = np.unique(sig, return_index=True)  # a copy of each set
            first = np.zeros(len(sig), bool)
            first[one] = True
            keep = np.repeat(first, counts)
            h, docs = h[keep], np.repeat(np.arange(len(counts), dtype=np.uint16), counts)[keep]
            high = h >> np.uint64(32)
            bucket = ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            h, docs, bucket = h[order], docs[order], bucket[order]
            starts = run_starts(bucket)
            for s, e in zip(starts, [*starts[1:], len(bucket)], strict=True):
                low = np.ascontiguousarray(h[s:e]).view(np.uint8).reshape(-1, 8)[:, : LOW_BITS // 8]
                used, held = np.unique(docs[s:e], return_counts=True)  # docs ascend within a bucket
                yield pa.RecordBatch.from_pylist([{"bucket": int(bucket[s]), "low": low.tobytes(), "held": held.astype(np.uint32).tobytes(), "sig": sig[used].tobytes(), "n": None, "doc_id": None}], schema=schema)

    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("low", "held", "sig", "n", "doc_id"))])
    return run


_SHARED = f"doc_id long, text_key long, sig long, n int, items array<{_ITEM}>"
_SHARED_ARROW = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("items", pa.list_(pa.int64()))])


def _buffers(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def _shared_shingles(table: pa.Table) -> pa.Table:
    """A bucket: the shingles that several classes hold, per class. Members (bucket < 0) pass through.

    An item is (floor(log2 of the number of classes), bucket and low bits): sorting items sorts lists from
    short to long, in the same order for all classes."""
    bucket = table.column("bucket")[0].as_py()
    sig = np.concatenate(_buffers(table.column("sig"), np.int64))
    if bucket < 0:
        n = np.concatenate(_buffers(table.column("n"), np.int32))
        ids = np.concatenate(_buffers(table.column("doc_id"), np.int64))
        keys = np.concatenate(_buffers(table.column("low"), np.int64))
        return pa.table([pa.array(ids), pa.array(keys), pa.array(sig), pa.array(n), pa.nulls(len(ids), pa.list_(pa.int64()))], schema=_SHARED_ARROW)
    lows = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, LOW_BITS // 8) for x in table.column("low")]
    wide = np.zeros((sum(map(len, lows)), 8), np.uint8)
    np.concatenate(lows, out=wide[:, : LOW_BITS // 8])
    h = wide.view(np.uint64).ravel()
    del lows
    names, at = np.unique(sig, return_inverse=True)
    cls = np.repeat(at.astype(np.int32), np.concatenate(_buffers(table.column("held"), np.uint32)))
    order = np.argsort(h, kind="stable")
    h, cls = h[order], cls[order]
    starts = run_starts(h)
    several = np.repeat(np.diff(np.append(starts, len(h))) > 1, np.diff(np.append(starts, len(h))))
    h, cls = h[several], cls[several]
    order = np.lexsort((cls, h))
    h, cls = h[order], cls[order]
    once = run_starts(h, cls)
    h, cls = h[once], cls[once]
    starts = run_starts(h)
    held = np.diff(np.append(starts, len(h)))
    df = np.repeat(held, held)
    keep = df > 1
    h, cls, df = h[keep], cls[keep], df[keep]
    length = np.floor(np.log2(df)).astype(np.uint64) if len(df) else np.zeros(0, np.uint64)
    item = ((length << np.uint64(57)) | ((np.uint64(bucket) << np.uint64(LOW_BITS)) & np.uint64((1 << 57) - 1)) | h).view(np.int64)
    order = np.argsort(cls, kind="stable")
    item, cls = item[order], cls[order]
    starts = run_starts(cls)
    of = cls[starts]
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(cls)), pa.int32()), pa.array(item))
    return pa.table([pa.nulls(len(of), pa.int64()), pa.nulls(len(of), pa.int64()), pa.array(names[of]), pa.nulls(len(of), pa.int32()), lists], schema=_SHARED_ARROW)


def needed(a: int, b: int) -> int:
    """The least overlap at which sets of a and b shingles link: 100 * overlap >= 75 * union."""
    return -(-3 * (a + b) // 7)


def _slices(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices flat[starts[i]:starts[i]+sizes[i]] one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


#: Occurrences that are merged at once.
MERGED = 1 << 22


def t_occurrence(queries: tuple, candidates: tuple, mu: float = 0.01, after: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """T-occurrence search: the pairs (query, candidate), by index, whose overlap reaches what their sizes ask for.

    Both sides are (items, offsets, sizes of the sets), items sorted per set. The inverted lists of the candidates'
    items are built once. A query needs T of its lists; DivideSkip leaves its L longest lists out, merges the
    others by counting their entries per candidate, and probes the long ones by binary search, in order of
    length, for the candidates with T - L occurrences or more; a candidate leaves when the lists that are
    left can't lift it to its own T. after: only candidates of a larger index than the query's, where both sides are one."""
    (q_flat, q_off, q_n), (c_flat, c_off, c_n) = queries, candidates
    m, nq = len(c_n), len(q_n)
    none = np.zeros(0, np.int64)
    owner = np.repeat(np.arange(m), np.diff(c_off))
    order = np.argsort(c_flat, kind="stable")
    owner, by_item = owner[order], c_flat[order]
    starts = run_starts(by_item)
    lengths = np.diff(np.append(starts, len(by_item)))
    names = by_item[starts]
    if not len(names):
        return none, none
    entries = np.repeat(np.arange(len(names)), lengths) * m + owner  # sorted: one binary search probes any list
    at = np.minimum(np.searchsorted(names, q_flat), len(names) - 1)
    hit = names[at] == q_flat
    q_of, q_list = np.repeat(np.arange(nq), np.diff(q_off))[hit], at[hit]
    order = np.lexsort((lengths[q_list], q_of))
    q_of, q_list = q_of[order], q_list[order]
    held = np.bincount(q_of, minlength=nq)
    first = np.cumsum(held) - held
    least = -(-3 * q_n // 4)
    longest = np.zeros(nq, np.int64)
    longest[held > 0] = lengths[q_list[(first + held - 1)[held > 0]]]
    n_long = np.where(longest > 1, np.minimum(least - 1, least / (mu * np.log2(np.maximum(longest, 2)) + 1)), 0).astype(np.int64)
    n_long = np.minimum(n_long, held)
    is_short = np.arange(len(q_of)) - first[q_of] < (held - n_long)[q_of]
    s_of, s_list = q_of[is_short], q_list[is_short]
    work = np.cumsum(np.bincount(s_of, lengths[s_list], nq)) + np.arange(1, nq + 1) * m
    found_q, found_c, q0 = [none], [none], 0
    while q0 < nq:
        q1 = max(q0 + 1, int(np.searchsorted(work, (work[q0 - 1] if q0 else 0) + MERGED, "right")))
        a, z = np.searchsorted(s_of, [q0, q1])
        size = lengths[s_list[a:z]]
        keys = np.repeat((s_of[a:z] - q0) * m, size) + _slices(owner, starts[s_list[a:z]], size)
        count = np.bincount(keys, minlength=(q1 - q0) * m)
        near = np.flatnonzero(count)
        q, c, count = near // m + q0, near % m, count[near]
        a_n, b_n = q_n[q], c_n[c]
        goal = -(-3 * (a_n + b_n) // 7)
        stay = (count >= goal - n_long[q]) & (4 * np.minimum(a_n, b_n) >= 3 * np.maximum(a_n, b_n))
        if after:
            stay &= c > q
        q, c, count, goal = q[stay], c[stay], count[stay], goal[stay]
        done = [(q[:0], c[:0])]
        for k in range(int(n_long[q0:q1].max(initial=0))):
            over = n_long[q] <= k
            if over.any():
                ok = over & (count >= goal)
                done.append((q[ok], c[ok]))
                q, c, count, goal = (x[~over] for x in (q, c, count, goal))
            if not len(q):
                break
            wanted = q_list[(first + held - n_long)[q] + k] * m + c
            spot = np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)
            count = count + (entries[spot] == wanted)
            stay = count >= goal - (n_long[q] - k - 1)
            q, c, count, goal = (x[stay] for x in (q, c, count, goal))
        ok = count >= goal
        done.append((q[ok], c[ok]))
        found_q += [x for x, _ in done]
        found_c += [x for _, x in done]
        q0 = q1
    return np.concatenate(found_q), np.concatenate(found_c)


def divide_skip(query: np.ndarray, n_query: int, candidates: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """t_occurrence() for one query: indices of the candidates that link with it, ascending."""
    off = np.cumsum([0, *map(len, candidates)])
    one = (query, np.array([0, len(query)]), np.array([n_query]))
    return np.sort(t_occurrence(one, (np.concatenate(candidates), off, np.asarray(sizes, np.int64)))[1])


def _search(batches):
    """Rows (query, q_n, q_items, cand, c_n, c_items), those of a query together -> linked pairs."""
    for b in batches:
        if not b.num_rows:
            continue
        q, c = b.column("query").to_numpy(), b.column("cand").to_numpy()
        q_n, c_n = b.column("q_n").to_numpy().astype(np.int64), b.column("c_n").to_numpy().astype(np.int64)
        q_lists, c_lists = b.column("q_items"), b.column("c_items")
        c_flat, c_off = c_lists.values.to_numpy(), c_lists.offsets.to_numpy()
        starts = run_starts(q)
        found_q, found_c = [], []
        for s, e in zip(starts, [*starts[1:], len(q)], strict=True):
            hits = divide_skip(q_lists[int(s)].values.to_numpy(), int(q_n[s]), [c_flat[c_off[i] : c_off[i + 1]] for i in range(s, e)], c_n[s:e])
            found_q.append(np.full(len(hits), q[s]))
            found_c.append(c[s:e][hits])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_q)), pa.array(np.concatenate(found_c))], names=["a", "b"])


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (query, cand) that link: (a, b)."""
    with_c = pairs.join(sets.select(F.col("sig").alias("cand"), F.col("n").alias("c_n"), F.col("items").alias("c_items")), "cand")
    both = with_c.join(sets.select(F.col("sig").alias("query"), F.col("n").alias("q_n"), F.col("items").alias("q_items")), "query")
    both = both.where("4 * least(q_n, c_n) >= 3 * greatest(q_n, c_n) and 7 * least(size(q_items), size(c_items)) >= 3 * (q_n + c_n)")
    return both.sortWithinPartitions("query").select("query", "q_n", "q_items", "cand", "c_n", "c_items").mapInArrow(_search, "a long, b long")


def _pivots(postings: DataFrame) -> DataFrame:
    """Pairs of each short list's pivot with the list's other classes.

    The pivot is the list's most central class, the one with the fewest shingles of its own: in a group of
    edited copies that is the text they come from."""
    rank = F.struct((F.col("n") - F.col("size")).alias("o"), F.xxhash64("sig").alias("r"), F.col("sig").alias("query"))
    lists = postings.groupBy("item").agg(F.min(rank).alias("p"), F.count("*").alias("held")).where("held > 1").select("item", "p.query")
    return postings.join(lists, "item").where("sig <> query").select("query", F.col("sig").alias("cand")).distinct()


#: Weight of a block's classes; a class weighs 1 and 1 more for each ITEMS_A_WEIGHT items that it has.
BLOCK_CLASSES = 256
ITEMS_A_WEIGHT = 512


def _joining(q: np.ndarray, c: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Indices of links that join classes of different roots which earlier ones did not join."""
    names = np.unique(root, return_inverse=True)[1]
    a, b = names[q], names[c]
    _, one = np.unique(np.minimum(a, b) * len(root) + np.maximum(a, b), return_index=True)
    group, out = np.arange(len(root)), []
    for i in one[a[one] != b[one]]:
        x, y = group[a[i]], group[b[i]]
        if x != y:
            group[group == x] = y
            out.append(i)
    return np.array(out, np.int64)


def _search_blocks(table: pa.Table, counted: bool) -> pa.Table:
    """Two blocks of classes (side 0 and 1; of one block only side 0): their links, as (a, b, n).

    Counted: the number n of each class's links as (class, null, n), and of the links only those that join
    classes of different roots, which are enough for the components; so the result grows with the classes
    and not with the links. Else all links. n is null in links."""
    side, sig, n, root = (table.column(x).to_numpy() for x in ("side", "sig", "n", "root"))
    alone = table.column("b1")[0].as_py() == table.column("b2")[0].as_py()
    lists = table.column("items").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, off = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)

    def of(rows):
        size = np.diff(off)[rows]
        return _slices(flat, off[:-1][rows], size), np.concatenate([[0], np.cumsum(size)]), n[rows].astype(np.int64)

    left = np.flatnonzero(side == 0)
    right = left if alone else np.flatnonzero(side == 1)
    q, c = t_occurrence(of(left), of(right), after=alone)
    q, c = left[q], right[c]
    times = np.bincount(q, minlength=len(sig)) + np.bincount(c, minlength=len(sig))
    told = _joining(q, c, root) if counted else np.arange(len(q))
    some = np.flatnonzero(times) if counted else np.zeros(0, np.int64)
    return pa.table(
        [
            pa.array(np.concatenate([sig[q[told]], sig[some]])),
            pa.concat_arrays([pa.array(sig[c[told]]), pa.nulls(len(some), pa.int64())]),
            pa.concat_arrays([pa.nulls(len(told), pa.int64()), pa.array(times[some].astype(np.int64))]),
        ],
        names=["a", "b", "n"],
    )


def _open_links(postings: DataFrame, sets: DataFrame, counted: bool = False) -> DataFrame:
    """All links between classes, each searched once: (a, b, n) as _search_blocks gives them.

    Linked classes meet in a short list. Classes joined by short lists form cells; the classes, ordered by cell
    and root, are cut into blocks. A short list is so cut into its parts in blocks, and each pair of blocks
    in which a list has parts is one search of a block's classes against the other's inverted lists. Only the
    classes of the lists that meet are moved, or the whole blocks where that is less. A pair of classes
    is met in one search only, and a task holds two blocks however long a list or large a cell is."""
    several = postings.groupBy("item").agg(F.min("sig").alias("b"), F.count("*").alias("held")).where("held > 1").select("item", "b")
    shared = stored(postings.join(several, "item").select("item", "sig", "root", "size", "b"), "jaccard-open")
    cells = components(shared.select(F.col("sig").alias("a"), "b").distinct())
    weight = (1 + F.floor(F.col("size") / ITEMS_A_WEIGHT)).cast("long")
    classes = shared.select("sig", "root", weight.alias("weight")).distinct().join(cells.select(F.col("v").alias("sig"), F.col("root").alias("cell")), "sig")
    placed = in_order(classes, ["cell", "root", "sig"], "jaccard-cells", "weight").withColumn("block", F.floor(F.col("position") / BLOCK_CLASSES)).drop("position", "weight")
    placed = stored(placed, "jaccard-blocks")
    entries = stored(shared.select("item", "sig").join(placed.select("sig", "block"), "sig"), "jaccard-entries")
    lists = entries.groupBy("item", "block").agg(F.count("*").alias("held"))
    one, two = (lists.select("item", F.col("block").alias(k), F.col("held").alias(f"{k}_held")) for k in ("b1", "b2"))
    met = stored(one.join(two, "item").where("b1 < b2 or (b1 = b2 and b1_held > 1)").select("item", "b1", "b2", F.expr("b1_held + if(b1 < b2, b2_held, 0)").alias("held")), "jaccard-met")
    pairs = stored(met.groupBy("b1", "b2").agg((F.sum("held") >= BLOCK_CLASSES).alias("whole")), "jaccard-block-pairs")
    lists_of = stored(met.join(pairs.where("not whole"), ["b1", "b2"]).select("item", "b1", "b2"), "jaccard-met-lists")
    members = stored(placed.join(sets.select("sig", "n", "items"), "sig"), "jaccard-members")
    sides = []
    for i, (k, where) in enumerate((("b1", "true"), ("b2", "b1 < b2"))):
        side = F.lit(i).alias("side")
        whole = pairs.where("whole").where(where).join(members, F.col(k) == F.col("block")).select("b1", "b2", side, "sig", "n", "root", "items")
        some = lists_of.where(where).join(entries.withColumnRenamed("block", k), ["item", k]).select("b1", "b2", "sig").distinct()
        sides += [whole, some.join(members, "sig").select("b1", "b2", side, "sig", "n", "root", "items")]
    sides[1:] = [reduce(DataFrame.unionByName, sides[1:])]
    return sides[0].unionByName(sides[1]).groupBy("b1", "b2").applyInArrow(lambda table: _search_blocks(table, counted), "a long, b long, n long")


def _with_roots(postings: DataFrame, roots: DataFrame) -> DataFrame:
    return postings.join(roots.withColumnRenamed("v", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))


def join_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sets (sig, n, items) -> components of linked classes (v, root), and the number of links of each (sig, n_links)."""
    short = F.slice("items", F.lit(1), F.size("items") - F.ceil(F.col("n") * 0.75).cast("int") + 1)
    postings = stored(sets.select("sig", "n", F.size("items").alias("size"), F.explode(short).alias("item")), "jaccard-lists")
    pairs = stored(_pivots(postings), "jaccard-pairs")
    near = components(linked(pairs, sets))
    links = stored(_open_links(_with_roots(postings, near), sets, counted=True), "jaccard-links")
    counts = links.where("n is not null").groupBy(F.col("a").alias("sig")).agg(F.sum("n").alias("n_links"))
    return components(near.toDF("a", "b").unionByName(links.where("b is not null").select("a", "b"))), counts


#: Stands for a null doc_id inside; a document with this id gets null.
NO_ID = (1 << 63) - 1


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, text_key (hash of its text), n_shingles, class_id and class_key (smallest doc_id
    with the same set, and the set's name), component_id and component_key (those of the component's class with the
    smallest doc_id), n_links (the number of other classes that the document's class links with)."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    read = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    dealt = read.mapInArrow(_deal(buckets), _DEALT)
    seen = stored(dealt.groupBy("bucket").applyInArrow(_shared_shingles, _SHARED), "jaccard-shared")
    members = seen.where("items is null").select("doc_id", "text_key", "sig", F.col("n").cast("long").alias("n_shingles"))
    sizes = members.groupBy("sig").agg(F.min("n_shingles").cast("int").alias("n"))
    shared = seen.where("items is not null").groupBy("sig").agg(F.array_sort(F.flatten(F.collect_list("items"))).alias("items"))
    sets = shared.join(sizes, "sig").where("4 * size(items) >= 3 * n").select("sig", "n", "items")
    roots, counts = join_classes(stored(sets, "jaccard-sets"))
    some = members.where("n_shingles > 0")
    classes = some.groupBy("sig").agg(F.min("doc_id").alias("class_id"))
    joined = stored(classes.join(roots.withColumnRenamed("v", "sig"), "sig", "left").join(counts, "sig", "left"), "jaccard-classes")
    own = F.struct("class_id", "sig")
    least = joined.where("root is not null").groupBy("root").agg(F.min(own).alias("_least"))
    named = join_hot(joined, least, "root", "left").withColumn("_least", F.coalesce("_least", own))
    named = named.select("sig", "class_id", F.col("_least.class_id").alias("component_id"), F.col("_least.sig").alias("component_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = join_hot(some, stored(named, "jaccard-named"), "sig").withColumnRenamed("sig", "class_key")
    alone = members.where("n_shingles = 0").withColumns({"class_id": F.col("doc_id"), "component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")})
    every = out.unionByName(alone.drop("sig"), allowMissingColumns=True)
    known = {c: F.nullif(F.col(c), F.lit(NO_ID)) for c in ("doc_id", "class_id", "component_id")}
    return every.withColumns(known).select("doc_id", "text_key", "n_shingles", "class_id", "class_key", "component_id", "component_key", "n_links")


def representatives(found: DataFrame) -> DataFrame:
    """(component_key, doc_id, text_key): the text of each component of near_duplicates() that stays."""
    first = found.where("n_shingles > 0 and class_key = component_key and doc_id <=> component_id")
    return first.groupBy("component_key").agg(F.min(F.struct("text_key", "doc_id")).alias("r")).select("component_key", "r.doc_id", "r.text_key")


def left_out(found: DataFrame) -> DataFrame:
    """The rows of near_duplicates() whose text another one of the component stands for; texts without words stay."""
    one = representatives(found).select("component_key", F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"))
    rows = join_hot(found.where("n_shingles > 0"), one, "component_key")
    return rows.where(~(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text")))).drop("_id", "_text")


def op3_jaccard_join(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")

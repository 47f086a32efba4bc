"""Spelling variants: words that differ by one code point, grouped under the far more frequent form.

Two words are near if one inserted, deleted or replaced code point turns one into the other, that is if their
common prefix and their common suffix together reach the longer length minus one. Words are laid out as padded
matrices of code points, once from the left and once from the right, and rows are compared block against
block: the first column that differs is the common prefix, from the other side the common suffix.

Which rows meet in a block: the shorter length m is cut into parts of `span` code points (MOST_PARTS parts at
most, so that long words stay linear). The edit of a near pair lies in one part, so both words agree on all
before it, counted from the left, and all after it, counted from the right. Every word gives one row a part for
m = its length and m = its length - 1, keyed by the hash of prefix, suffix and part; rows are dealt and
sorted by key, and only rows of one key are compared. Up to span * MOST_PARTS code points the words of a key
differ in `span` (or span + 1) of them, so a key has a bounded number of words whatever the corpus holds. A pair is
counted in the part where its prefix ends and nowhere else, so there is no list of pairs to make distinct: a task gives
per word of its keys how many near words it met and the best of them.

Defined cases: null and empty texts have no words; a null doc_id counts as the empty string; runs of any length are
words; repeated rows count as occurrences of their own; of near words with equal n the smallest in code-point
order is the form; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, partitions, stored
from .tokens import mix, run_starts

RUN = r"[A-Za-z\x{C0}-\x{FF}]"
MOST_PARTS = 16
#: Code points of a matrix that is compared at once.
CELLS = 1 << 21
_BASE, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def count_words(docs: DataFrame, shortest: int = 7, least: int = 2, slip: int = 31) -> DataFrame:
    """Distinct runs of at least `shortest` letters with `least` occurrences or more: word, n.

    Lower-cases A-Z only. Where `slip` divides h, the CRC-32 of `<doc_id>:<run>`, the run loses its code point h % length."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    # a greedy match of at least `shortest` letters starts at a run's first letter: shorter runs have none
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(low, F.lit(f"{RUN}{{{shortest},}}"), 0)).alias("run"))
    h, size = F.col("h"), F.length("run")
    at = (h % size).cast("int")
    runs = runs.withColumn("h", F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary")))
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    words = runs.select(F.when(h % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _step(m: int, span: int) -> int:
    return max(span, -(-m // MOST_PARTS))


def _matrix(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), size)


def keyed(words: DataFrame, shortest: int, span: int) -> DataFrame:
    """A row per word and part: kind (m and part), key, word, n."""

    def run(batches):
        for b in batches:
            sizes = pc.utf8_length(b.column("word")).to_numpy(zero_copy_only=False)
            names = b.column("word").to_pylist()
            for size in np.unique(sizes).tolist():
                every = np.flatnonzero(sizes == size)
                for at in range(0, len(every), max(1, CELLS // size)):
                    rows = every[at : at + max(1, CELLS // size)]
                    values = mix(_matrix([names[i] for i in rows], size).astype(np.uint64) + _TURN)
                    with np.errstate(over="ignore"):
                        powers = np.cumprod(np.full(size, _BASE, np.uint64))
                        front = np.cumsum(values * powers, axis=1)
                        back = np.cumsum(values[:, ::-1] * powers, axis=1)
                        nothing = np.zeros(len(rows), np.uint64)
                        for m in (size, size - 1):
                            if m < shortest:
                                continue
                            step = _step(m, span)
                            for part in range(-(-m // step)):
                                before, behind = part * step, max(0, m - (part + 1) * step)
                                kind = m * MOST_PARTS + part
                                left = front[:, before - 1] if before else nothing
                                right = back[:, behind - 1] if behind else nothing
                                key = mix(mix(left + np.uint64(kind)) * _TURN + right)
                                some = b.take(pa.array(rows))
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(np.full(len(rows), kind), pa.int64()), pa.array(key.view(np.int64)), some.column("word"), some.column("n")],
                                    names=["kind", "key", "word", "n"],
                                )

    return words.select("word", "n").mapInArrow(run, "kind long, key long, word string, n long")


def compare(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows i against rows j of the matrices padded at the right (left) and at the left (right): whether they are near, and their common prefix."""
    prefix = (left[i] == left[j]).argmin(axis=1)
    suffix = (right[i] == right[j])[:, ::-1].argmin(axis=1)
    return prefix + suffix >= longer - 1, prefix


def _tile(rows: pa.Table, m: int, span: int):
    """Near words among rows of whole keys of one m: (row, other row) of each near pair, both ways; rows are in the order of `rows`."""
    sizes = pc.utf8_length(rows.column("word")).to_numpy()
    key, kind = rows.column("key").to_numpy(), rows.column("kind").to_numpy()
    order = np.lexsort((sizes, key, kind))
    key, kind, sizes = key[order], kind[order], sizes[order]
    starts = run_starts(kind, key)
    ends = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))
    short = np.flatnonzero((sizes == m) & (ends - np.arange(len(key)) > 1))
    alone = np.ones(len(key), bool)
    for s, e in ((short, ends[short]),):
        marks = np.zeros(len(key) + 1, np.int64)
        np.add.at(marks, s, 1)
        np.add.at(marks, e, -1)
        alone = np.cumsum(marks)[:-1] == 0
    kept = np.flatnonzero(~alone)  # words without a partner need no matrix
    if not len(kept):
        return order[:0], order[:0]
    spot = np.cumsum(~alone) - 1
    names = rows.column("word").take(pa.array(order[kept])).to_pylist()
    left, right = np.zeros((len(kept), m + 1), np.uint32), np.zeros((len(kept), m + 1), np.uint32)
    exact = sizes[kept] == m
    for some, size in ((np.flatnonzero(exact), m), (np.flatnonzero(~exact), m + 1)):
        if len(some):
            left[some, :size] = right[some, m + 1 - size :] = _matrix([names[k] for k in some], size)
    step, found = _step(m, span), []
    room = ends[short] - short
    far = 1
    while len(short):
        for at in range(0, len(short), max(1, CELLS // (m + 1))):
            i = short[at : at + max(1, CELLS // (m + 1))]
            j = i + far
            near, prefix = compare(left, right, spot[i], spot[j], sizes[j])
            here = np.minimum(prefix, m - 1) // step == kind[i] % MOST_PARTS
            found.append((i[near & here], j[near & here]))
        far += 1
        keep = room > far
        short, room = short[keep], room[keep]
    one, two = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return order[np.concatenate([one, two])], order[np.concatenate([two, one])]


def _best(rows: pa.Table, row: np.ndarray, other: np.ndarray):
    """Per word of near pairs: word, number of near words, the most frequent of them and its n."""
    n = rows.column("n").to_numpy()
    names = np.array(rows.column("word").take(pa.array(other)).to_pylist(), object)
    _, rank = np.unique(names, return_inverse=True)
    order = np.lexsort((rank, -n[other], row))
    starts = run_starts(row[order])
    first = order[starts]
    counts = np.diff(np.append(starts, len(order)))
    return pa.RecordBatch.from_arrays(
        [rows.column("word").take(pa.array(row[first])).combine_chunks(), pa.array(counts, pa.int64()), pa.array(n[other[first]], pa.int64()), pa.array(names[first].tolist(), pa.string())],
        names=["word", "n_near", "best_n", "best"],
    )


def near_words(words: DataFrame, shortest: int = 7, span: int = 2) -> DataFrame:
    """words (word, n; distinct) -> per task and word that met a near word: word, n_near, best_n, best."""

    def run(batches):
        held, size, kind = [], 0, -1

        def flush(rows, m):
            row, other = _tile(rows, m, span)
            return [_best(rows, row, other)] if len(row) else []

        for b in batches:
            while b.num_rows:
                kinds = b.column("kind").to_numpy() // MOST_PARTS
                if size and kinds[0] != kind:
                    yield from flush(pa.Table.from_batches(held), kind)
                    held, size = [], 0
                kind = int(kinds[0])
                k = int(np.searchsorted(kinds, kind, "right"))
                held.append(b.slice(0, k))
                size, b = size + k, b.slice(k)
                if size * (kind + 1) > CELLS:  # whole keys are compared, the last one waits for its rest
                    rows = pa.Table.from_batches(held).combine_chunks()
                    last = run_starts(rows.column("kind").to_numpy(), rows.column("key").to_numpy())[-1]
                    if last:
                        yield from flush(rows.slice(0, last), kind)
                        held, size = rows.slice(last).to_batches(), rows.num_rows - int(last)
        if size:
            yield from flush(pa.Table.from_batches(held), kind)

    dealt = keyed(words, shortest, span).repartition(partitions(words.sparkSession), "key").sortWithinPartitions("kind", "key")
    return dealt.mapInArrow(run, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """forms (word, form) -> (word, root): where following forms ends. Each round doubles the steps taken; raises if forms go round."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        now = stored(now, "spelling-roots")
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if not now.join(step, "root", "left_semi").limit(1).count():
            return now
        now = now.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    raise ValueError("forms go round")


def group(words: DataFrame, factor: int = 10, shortest: int = 7, span: int = 2) -> DataFrame:
    """words (word, n; distinct) -> word, form, root, n, n_near, form_n.

    The form is the near word of largest n if that is at least `factor` times the word's own; so n grows
    along forms and the ways to the roots are logarithmic in n."""
    words = stored(words.select("word", "n"), "spelling-words")
    met = near_words(words, shortest, span)
    nothing = {"n_near": F.lit(0).cast("long"), "best_n": F.lit(None).cast("long"), "best": F.lit(None).cast("string")}
    both = words.withColumns(nothing).unionByName(met.withColumn("n", F.lit(None).cast("long")))
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))))
    found = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), first.alias("_first"))
    takes = -F.col("_first.less") >= factor * F.col("n")
    found = found.select("word", "n", "n_near", F.when(takes, F.col("_first.word")).alias("form"), F.when(takes, -F.col("_first.less")).alias("form_n"))
    found = stored(found, "spelling-forms")
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir):
    return group(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))

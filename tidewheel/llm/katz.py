"""Language-model scoring with a Katz backoff model of word bigrams.

Tokens are lower-cased words and one end per text. Counts are discounted by Good-Turing:

    P(w)     = d1(c(w)) c(w) / N                 for known words; what is left is the unknown word's
    P(w | h) = d2(c(h, w)) c(h, w) / c(h)        if c(h, w) >= least
             = alpha(h) P(w)                     otherwise
    alpha(h) = (1 - sum of P(w | h) over kept w) / (1 - sum of P(w) over kept w)

alpha is computed from the stored rows themselves, so every context's probabilities sum to 1. The operator keeps
every counted bigram (least = 1), those seen once with their discount d2(1). fit() can prune: bigrams seen
less than `least` times, MIN_BIGRAM if not given, are counted (Good-Turing needs them, contexts count them) and
left to the backoff. A context that would keep no mass for the rest is discounted by c / (c + 1). Where
the data has no Good-Turing estimate (a count of counts is 0 or the ratio leaves (0, 1)), the discount is
(c - 0.5) / c.

How it runs: tasks turn blocks of texts into their distinct bigrams and deal them by context into
buckets, counts for training, occurrences for scoring; so what is shuffled are a block's distinct
bigrams and not its tokens. The tables `unigrams` (word, c) and `bigrams` (a packed record of contexts, words and
counts per bucket, partitioned by bucket, beside the words that it asks for) are in the shared folder; `words`
(bucket, word, c: the counts of the words in which a bucket's bigrams end) joins the two when scoring; so bigrams
are moved once, by context, and never joined row by row with the lower order. Arrays are packed without loss. A scoring bucket holds whole contexts and
resolves P(w | h) for its bigrams, and P(w) and log10 alpha for its words as contexts of the next token:
log10 P(text) = sum of [log10 alpha(h) + log10 P(w)] + sum over kept bigrams of
[log10 P(w | h) - log10 alpha(h) - log10 P(w)]. Contexts with a large share of all tokens are spread over
buckets by their next word; there are at most HOT_PER_BUCKET times as many of them as buckets, and
only for those the driver knows alpha. Words are known by their 64-bit hash.

Defined cases: null and empty texts are one end token; without training texts all words are unknown with
probability 1; repeated rows are texts of their own; null doc_ids are training texts and stay null; texts of any
length are scored whole; other columns of the input, whatever their names, are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import new_folder, partitions, stored
from .tokens import blocks, mix, record_group, run_starts, split_block, word_hashes

K = 5
BLOCK_BYTES = 12 << 20
#: fit()'s default for `least`; the operator keeps all bigrams.
MIN_BIGRAM = 2
HOT_PER_BUCKET = 4
FOLDS, HELD_OUT = 7, 2
#: Names of the start and the end; a blank can't be in a word.
START, END = (int(x) for x in word_hashes(["<s> ", "</s> "]).view(np.int64))


#: Stands for a null doc_id inside; a document with this id gets null. A null doc_id is not held out.
NO_ID = (1 << 63) - 1


def held_out(doc_id: int) -> bool:
    return doc_id != NO_ID and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def discounts(count_of_counts: list[int]) -> np.ndarray:
    """Good-Turing factors for counts 0..K (entry 0 is unused); beyond K counts are trusted. Takes n1..n(K+1)."""
    n = [0, *count_of_counts]
    out = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for c in range(1, K + 1):
        d = 0.0
        if n[c] and n[c + 1] and common < 1:
            d = ((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common)
        out[c] = d if 0 < d < 1 else (c - 0.5) / c
    return out


def factor(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c > K, 1.0, d[np.minimum(c, K)])


def discounted(column, d: np.ndarray):
    """factor() * count as a column expression."""
    out = F.lit(1.0)
    for c in range(1, K + 1):
        out = F.when(column == c, F.lit(float(d[c]))).otherwise(out)
    return column * out


class Bigrams:
    """The bigrams of a block in token order: context and word as indices into hashes, and the text."""

    def __init__(self, rows: pa.RecordBatch):
        b = split_block(rows)
        n, texts = b.sizes, len(rows)
        self.hashes = np.concatenate([b.hashes.view(np.int64), np.array([START, END], np.int64)])
        start, end = len(b.hashes), len(b.hashes) + 1
        ends = b.starts[1:] + np.arange(1, texts + 1) - 1  # places of the end tokens
        which = b.which.astype(np.int32)
        self.words = np.insert(which, b.starts[1:], end) if texts else which
        self.context = np.empty_like(self.words)
        self.context[1:] = self.words[:-1]
        firsts = np.concatenate([[0], ends[:-1] + 1]) if texts else ends
        self.context[firsts] = start
        self.text = np.repeat(np.arange(texts, dtype=np.int32), n + 1)
        self.n_tokens = n + 1
        self.doc_id = rows.column("doc_id").to_numpy(zero_copy_only=False)
        self.held = np.fromiter(map(held_out, self.doc_id.tolist()), bool, texts)


def bucket_of(context: np.ndarray, word: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by context, for hot contexts by context and word."""
    return np.where(np.isin(context, hot), context ^ word, context) % buckets


def unigram_counts(docs: DataFrame) -> DataFrame:
    """Training counts: word (hash), c. The start counts as no token."""

    def run(batches):
        for rows in blocks(batches, BLOCK_BYTES):
            b = Bigrams(rows)
            c = np.bincount(b.words[~b.held[b.text]], minlength=len(b.hashes))
            seen = c > 0
            yield pa.RecordBatch.from_arrays([pa.array(b.hashes[seen]), pa.array(c[seen])], names=["word", "n"])

    return _read(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))


_DEALT = "bucket int, block long, texts int, contexts binary, runs binary, names binary, words binary, counts binary, places binary, doc_id binary"
_DEALT_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("texts", pa.int32()), *((c, pa.binary()) for c in ("contexts", "runs", "names", "words", "counts", "places", "doc_id"))])


def _pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """x in few bytes, whole: its length, then its byte planes under zstd; of ascending runs, the planes of the differences."""
    d = np.diff(x, prepend=x.dtype.type(0)) if ascending else x
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(value, dtype, ascending: bool = False) -> np.ndarray:
    """The array of a _pack() column's binary value."""
    buffer, size = value.as_buffer(), np.dtype(dtype).itemsize
    n = int.from_bytes(buffer.slice(0, 8).to_pybytes(), "little")
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(buffer.slice(8), n * size, "zstd"), np.uint8).reshape(size, n)
    d = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(d, dtype=dtype) if ascending else d


def _indexed(words: np.ndarray) -> tuple[bytes, bytes]:
    """The distinct words in order, and each word's index among them in as few bytes as their number asks for."""
    names, index = np.unique(words, return_inverse=True)
    return _pack(names, True), _pack(index.astype(_index_type(len(names))), True)


def _index_type(n: int):
    return np.uint16 if n <= 1 << 16 else np.uint32


def _words_of(names: np.ndarray, index) -> np.ndarray:
    """The words of an _indexed() pair; index is the column's binary value."""
    return names[_unpack(index, _index_type(len(names)), True)]


def _dealt_rows(b: Bigrams, pick: np.ndarray | None, hot: np.ndarray, buckets: int, block: int, with_places: bool):
    """A record per bucket with the block's distinct bigrams: contexts and their runs, words, counts and (scoring) the texts."""
    context, word, text = (x if pick is None else x[pick] for x in (b.context, b.words, b.text))
    if not len(word):
        return
    size = len(b.hashes)
    key = context * np.int64(size) + word
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    del context, word
    starts = run_starts(key)
    counts = np.diff(np.append(starts, len(key)))
    h, w = b.hashes[key[starts] // size], b.hashes[key[starts] % size]
    bucket = bucket_of(h, w, hot, buckets)
    by = np.lexsort((w, h, bucket))
    n_tokens = len(key)
    del key
    h, w, bucket, counts_by = h[by], w[by], bucket[by], counts[by]
    if with_places:
        ends = np.cumsum(counts_by)
        take = np.arange(n_tokens) + np.repeat(starts[by] - (ends - counts_by), counts_by)
        places = text[order][take].astype(np.uint16)
        bounds = np.concatenate([[0], ends])
        del take
    del order, by, counts
    edges = run_starts(bucket)
    for s, e in zip(edges, [*edges[1:], len(bucket)], strict=True):
        first = run_starts(h[s:e])
        names, index = _indexed(w[s:e])
        yield pa.RecordBatch.from_pylist(
            [
                {
                    "bucket": int(bucket[s]),
                    "block": block,
                    "texts": len(b.doc_id),
                    "contexts": _pack(h[s:e][first], True),
                    "runs": _pack(np.diff(np.append(first, e - s)).astype(np.uint32)),
                    "names": names,
                    "words": index,
                    "counts": _pack(counts_by[s:e].astype(np.uint32)),
                    "places": _pack(places[bounds[s] : bounds[e]]) if with_places else None,
                    "doc_id": None,
                }
            ],
            schema=_DEALT_ARROW,
        )


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc_id"), "text")


def _deal_counts(hot, buckets):
    def run(batches):
        for rows in blocks(batches, BLOCK_BYTES):
            b = Bigrams(rows)
            yield from _dealt_rows(b, np.flatnonzero(~b.held[b.text]), hot, buckets, 0, False)

    return run


def _deal_scores(hot, buckets):
    """As for counts, of all texts with their places; and per block one record with its texts' ids and sizes."""
    from pyspark import TaskContext

    def run(batches):
        part = TaskContext.get().partitionId()
        for k, rows in enumerate(blocks(batches, BLOCK_BYTES)):
            b, block = Bigrams(rows), (part << 32) + k
            empty = dict.fromkeys(_DEALT_ARROW.names)
            yield pa.RecordBatch.from_pylist([empty | {"bucket": -1 - record_group(part, k, buckets), "block": block, "texts": len(rows), "doc_id": b.doc_id.astype(np.int64).tobytes(), "counts": b.n_tokens.astype(np.int64).tobytes()}], schema=_DEALT_ARROW)
            yield from _dealt_rows(b, None, hot, buckets, block, True)

    return run


def _column(table: pa.Table, name: str, dtype, ascending: bool = False) -> list[np.ndarray]:
    return [_unpack(x, dtype, ascending) for x in table.column(name)]


#: kind 0: a context (key) and its count; 1: a bucket's bigrams, packed, words as indices into those of kind 2; 2: a word (key) of a bucket's bigrams, with
#: its count in training where that is known; 3: how many bigrams (c) of a count (key); 4: a hot context's bigram.
_COUNTED = "kind int, bucket int, key long, other long, c long, contexts binary, runs binary, words binary, counts binary"
_PACKED = ("contexts", "runs", "words", "counts")
_COUNTED_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("key", pa.int64()), ("other", pa.int64()), ("c", pa.int64()), *((x, pa.binary()) for x in _PACKED)])


def _rows(kind: int, bucket: int, key: np.ndarray, c: np.ndarray | None = None, other: np.ndarray | None = None) -> pa.Table:
    n = len(key)
    longs = [pa.nulls(n, pa.int64()) if x is None else pa.array(np.asarray(x, np.int64)) for x in (key, other, c)]
    return pa.table([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, bucket, np.int32)), *longs, *[pa.nulls(n, pa.binary())] * 4], schema=_COUNTED_ARROW)


def _count_bucket(table: pa.Table, least: int, hot: np.ndarray) -> pa.Table:
    """Adds up a bucket's bigrams. Those with c >= least are one packed record (contexts and their runs, words, counts),
    with a row for each distinct word, which asks for the word's own count, and one for each bigram of a hot context."""
    h = np.concatenate([np.repeat(c, r) for c, r in zip(_column(table, "contexts", np.int64, True), _column(table, "runs", np.uint32), strict=True)])
    w = np.concatenate([_words_of(x, i) for x, i in zip(_column(table, "names", np.int64, True), table.column("words"), strict=True)])
    n = np.concatenate(_column(table, "counts", np.uint32)).astype(np.int64)
    bucket = table.column("bucket")[0].as_py()
    order = np.lexsort((w, h))
    h, w, n = h[order], w[order], n[order]
    starts = run_starts(h, w)
    c = np.add.reduceat(n, starts)
    h, w = h[starts], w[starts]
    of_counts = np.bincount(np.minimum(c, K + 2), minlength=K + 3)[1 : K + 2]
    kept = c >= least
    h, w, c = h[kept], w[kept], c[kept]
    first = run_starts(h)
    runs = np.diff(np.append(first, len(h))).astype(np.uint32)
    packed = {"kind": 1, "bucket": bucket, "key": None, "other": None, "c": None, "contexts": _pack(h[first], True), "runs": _pack(runs), "words": _indexed(w)[1], "counts": _pack(c.astype(np.uint64))}
    spread = np.isin(h, hot)
    parts = [pa.Table.from_pylist([packed], schema=_COUNTED_ARROW), _rows(2, bucket, np.unique(w)), _rows(3, bucket, np.arange(1, K + 2), of_counts), _rows(4, bucket, h[spread], c[spread], w[spread])]
    return pa.concat_tables(parts)


class Model:
    """Tables and constants of a fitted model.

    unigrams (word, c); bigrams: a packed record per bucket, partitioned by bucket; words (bucket, word, c): the counts of
    the words that each bucket's bigrams end in, joined from stored tables when it is read."""

    def __init__(self, unigrams, bigrams, words, tokens, kinds, d1, d2, unknown, hot, buckets):
        self.unigrams, self.bigrams, self.words = unigrams, bigrams, words
        self.tokens, self.kinds, self.d1, self.d2, self.unknown = tokens, kinds, d1, d2, unknown
        self.hot, self.buckets = hot, buckets

    def p_word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, factor(self.d1, c) * c / max(1, self.tokens), self.unknown)


def fit(docs: DataFrame, least: int = MIN_BIGRAM) -> Model:
    """Fits the model to the texts that are not held out; it keeps the bigrams seen at least `least` times."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    unigrams = stored(unigram_counts(docs), "katz-unigrams")
    ones = [F.sum((F.col("c") == c).cast("long")).alias(f"n{c}") for c in range(1, K + 2)]
    total = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds"), *ones).first()
    d1 = discounts([total[f"n{c}"] or 0 for c in range(1, K + 2)])
    mass = unigrams.groupBy("c").count().agg(F.sum(discounted(F.col("c"), d1) * F.col("count"))).first()[0] or 0.0
    unknown = 1.0 - mass / total.tokens if total.tokens else 1.0
    share = max(2, total.tokens // (HOT_PER_BUCKET * buckets))
    hot = {r.word: r.c for r in unigrams.where((F.col("c") > share) & (F.col("word") != END)).collect()}
    texts = unigrams.where(F.col("word") == END).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    if texts > share:
        hot[START] = texts
    hot_keys = np.array(sorted(hot), np.int64)

    dealt = _read(docs).mapInArrow(_deal_counts(hot_keys, buckets), _DEALT)
    counted = dealt.groupBy("bucket").applyInArrow(lambda table: _count_bucket(table, least, hot_keys), _COUNTED)
    path = new_folder(spark, "katz-bigrams")
    counted.write.partitionBy("kind", "bucket").parquet(path)
    counted = spark.read.schema(_COUNTED).parquet(path)
    of_counts = {r.key: r.n for r in counted.where("kind = 3").groupBy("key").agg(F.sum("c").alias("n")).collect()}
    d2 = discounts([of_counts.get(c, 0) for c in range(1, K + 2)])

    own = unigrams.select(F.col("word").alias("key"), F.col("c").alias("own"))
    words = counted.where("kind = 2").select("bucket", "key").join(own, "key").select("bucket", F.col("key").alias("word"), F.col("own").alias("c"))
    bigrams = counted.where("kind = 1").select("bucket", *_PACKED)
    model = Model(unigrams, bigrams, words, total.tokens, total.kinds, d1, d2, unknown, {}, buckets)

    p = discounted(F.col("own"), d1) / F.lit(float(max(1, total.tokens)))
    spread = counted.where("kind = 4").select(F.col("key").alias("context"), F.col("other").alias("key"), "c").join(own, "key")
    sums = spread.groupBy("context").agg(F.sum(discounted(F.col("c"), d2)).alias("kept"), F.sum(p).alias("lower")).collect() if hot else []
    alpha = {r.context: (r.kept, r.lower) for r in sums}
    model.hot = {h: (c, *alpha.get(h, (0.0, 0.0))) for h, c in hot.items()}
    return model


def backoff(count: np.ndarray, kept: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context: the divisor of discounted counts, and alpha. kept: sum of discounted counts, lower: sum of P(w), over kept words."""
    count = count.astype(float)
    seen = np.where(count > 0, count, 1.0)
    full = seen - kept <= 1e-9 * seen
    divisor = np.where(full, seen * (seen + 1) / seen, seen)
    left = 1.0 - kept / divisor
    rest = 1.0 - lower
    alpha = np.where(rest > 1e-15, left / np.where(rest > 1e-15, rest, 1.0), 1.0)
    return divisor, alpha


def _pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64))


_SCORED = "block long, known binary, base binary, score binary, doc_id binary, n_tokens binary"
_SCORED_ARROW = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("known", "base", "score", "doc_id", "n_tokens"))])


def _score_bucket(model: dict):
    """Cogrouped: dealt occurrences of a bucket, and its rows of the model -> per block partial sums for its texts."""
    d1, d2, tokens, kinds, unknown, hot = (model[k] for k in ("d1", "d2", "tokens", "kinds", "unknown", "hot"))

    def p_of(c):
        return np.where(c > 0, factor(d1, c) * c / max(1, tokens), unknown)

    def run(dealt: pa.Table, rows: pa.Table) -> pa.Table:
        if not dealt.num_rows:
            return _SCORED_ARROW.empty_table()
        if dealt.column("bucket")[0].as_py() < 0:
            return pa.table([dealt.column("block"), *[pa.nulls(dealt.num_rows, pa.binary())] * 3, dealt.column("doc_id"), dealt.column("counts")], schema=_SCORED_ARROW)
        kind, key, count = (pc.fill_null(rows.column(x), 0).to_numpy() for x in ("kind", "key", "c"))
        names, counts = key[kind == 0], count[kind == 0]
        if len(hot):
            keys = np.array(sorted(hot), np.int64)
            names = np.concatenate([names, keys])
            counts = np.concatenate([counts, np.array([hot[int(k)][0] for k in keys], np.int64)])
        order = np.argsort(names, kind="stable")
        names, counts = names[order], counts[order]
        once = run_starts(names)
        names, counts = names[once], counts[once]
        packed = rows.filter(pa.array(kind == 1))
        h = np.concatenate([np.zeros(0, np.int64), *(np.repeat(x, r) for x, r in zip(_column(packed, "contexts", np.int64, True), _column(packed, "runs", np.uint32), strict=True))])
        n = np.concatenate([np.zeros(0, np.uint64), *_column(packed, "counts", np.uint64)]).astype(np.int64)
        order = np.argsort(key[kind == 2])
        last, last_c = key[kind == 2][order], count[kind == 2][order]
        # a bucket has one packed record; its indices are into its distinct words in order, which `last` holds
        where = np.concatenate([np.zeros(0, np.int64), *_column(packed, "words", _index_type(len(last)), True)]).astype(np.int64)
        w, wc = last[where], last_c[where]
        at = np.searchsorted(names, h)
        kept = np.bincount(at, factor(d2, n) * n, len(names))
        lower = np.bincount(at, p_of(wc), len(names))
        for k, (_, a, b) in hot.items():
            spot = np.searchsorted(names, k)
            kept[spot], lower[spot] = a, b
        divisor, alpha = backoff(counts, kept, lower)
        log_alpha = np.log10(alpha)
        gain = np.log10(factor(d2, n) * n / divisor[at]) - log_alpha[at] - np.log10(p_of(wc))
        pair = _pair_key(h, w)
        order = np.argsort(pair)
        pair, gain, h, w = pair[order], gain[order], h[order], w[order]
        log_word, log_base = np.log10(p_of(counts)), np.log10((counts + 1.0) / (tokens + kinds + 1.0))
        none_word, none_base = np.log10(unknown), np.log10(1.0 / (tokens + kinds + 1.0))
        end_at = model["end"]
        out = []
        for i in range(dealt.num_rows):
            get = lambda name, dtype, ascending=False: _unpack(dealt.column(name)[i], dtype, ascending)  # noqa: B023, E731
            texts = dealt.column("texts")[i].as_py()
            ctx, runs = get("contexts", np.int64, True), get("runs", np.uint32)
            words, times, places = _words_of(get("names", np.int64, True), dealt.column("words")[i]), get("counts", np.uint32), get("places", np.uint16)
            spot = np.minimum(np.searchsorted(names, ctx), max(0, len(names) - 1))
            known = names[spot] == ctx if len(names) else np.zeros(len(ctx), bool)
            real = ctx != START
            own_alpha = np.where(known, log_alpha[spot], 0.0) if len(names) else np.zeros(len(ctx))
            own_word = np.where(known, log_word[spot], none_word) if len(names) else np.full(len(ctx), none_word)
            own_base = np.where(known, log_base[spot], none_base) if len(names) else np.full(len(ctx), none_base)
            per_context = np.stack([own_alpha + np.where(real, own_word, 0.0), np.where(real, own_base, 0.0), (known & real).astype(float)])
            per_pair = np.repeat(per_context, runs, axis=1)
            is_end = words == END
            per_pair[0][is_end] += end_at[0]
            per_pair[1][is_end] += end_at[1]
            per_pair[2][is_end] += end_at[2]
            if len(pair):
                full = np.repeat(ctx, runs)
                key = _pair_key(full, words)
                found = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
                same = (h[found] == full) & (w[found] == words)
                per_pair[0][same] += gain[found[same]]
            sums = [np.bincount(places, np.repeat(v, times), texts) for v in per_pair]
            out.append({"block": dealt.column("block")[i].as_py(), "known": sums[2].astype(np.float64).tobytes(), "base": sums[1].tobytes(), "score": sums[0].tobytes(), "doc_id": None, "n_tokens": None})
        return pa.Table.from_pylist(out, schema=_SCORED_ARROW)

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sum_block(tokens: int):
    def run(table: pa.Table) -> pa.Table:
        ids = next(x for x in table.column("doc_id") if x.is_valid)
        doc_id = np.frombuffer(ids.as_buffer(), np.int64)
        n = np.frombuffer(next(x for x in table.column("n_tokens") if x.is_valid).as_buffer(), np.int64)
        sums = {}
        for name in ("known", "base", "score"):
            sums[name] = np.zeros(len(doc_id))
            for x in table.column(name):
                if x.is_valid:
                    sums[name] = sums[name] + np.frombuffer(x.as_buffer(), np.float64)
        held = np.fromiter(map(held_out, doc_id.tolist()), bool, len(doc_id))
        return pa.table(
            [pa.array(doc_id), pa.array(held), pa.array(n), pa.array(np.rint(sums["known"]).astype(np.int64)), pa.array(np.full(len(doc_id), tokens)), pa.array(sums["base"]), pa.array(sums["score"])],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    ends = model.unigrams.where(F.col("word") == END).agg(F.coalesce(F.max("c"), F.lit(0))).first()[0]
    c = np.array([ends])
    end_at = (float(np.log10(model.p_word(c))[0]), float(np.log10((ends + 1) / (model.tokens + model.kinds + 1))), float(ends > 0))
    hot_keys = np.array(sorted(model.hot), np.int64)
    facts = {"d1": model.d1, "d2": model.d2, "tokens": model.tokens, "kinds": model.kinds, "unknown": model.unknown, "hot": model.hot, "end": end_at}
    dealt = _read(docs).mapInArrow(_deal_scores(hot_keys, model.buckets), _DEALT)
    start = docs.sparkSession.createDataFrame([(START, int(ends))], "word long, c long")
    none = [F.lit(None).cast("binary").alias(x) for x in _PACKED]
    kind = lambda k: F.lit(k).alias("kind")
    contexts = model.unigrams.union(start).select(kind(0), F.pmod("word", F.lit(model.buckets)).cast("int").alias("bucket"), F.col("word").alias("key"), "c", *none)
    words = model.words.select(kind(2), "bucket", F.col("word").alias("key"), "c", *none)
    bigrams = model.bigrams.select(kind(1), "bucket", F.lit(None).cast("long").alias("key"), F.lit(None).cast("long").alias("c"), *_PACKED)
    rows = contexts.unionByName(words).unionByName(bigrams)
    parts = dealt.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(_score_bucket(facts), _SCORED)
    out = parts.groupBy("block").applyInArrow(_sum_block(model.tokens), _RESULT)
    return out.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))


def op1_katz(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, least=1))



"""Katz backoff of any order: a table of n-grams and a table of contexts per order, evaluated by recursion over the orders.

    P_1(w)     = d(c(w)) c(w) / N                       for known words; the rest is the unknown word's
    P_k(w | h) = d_k(c(h, w)) c(h, w) / c(h)            for counted n-grams of order k
               = alpha_k(h) P_{k-1}(w | h')             otherwise; h' is h without its first word, alpha 1 for unseen h

Every context's probabilities sum to 1: alpha_k(h) shares out what the counted words leave, divided by what they do not have in the order below.
Definitions of tokens, discounts and training texts are those of `katz`; with order 2 both give the same scores. `katz`
packs order 2 for the check tool's limits on disk; this module takes any order in plain tables: a row per n-gram.

One pass turns texts into their distinct n-grams of the highest order, each with the hashes of all its contexts; lower orders are sums of
higher ones, as every token has one n-gram of each order (starts are padded). Joins keep hot keys where they are
(`shared.join_hot`), aggregates combine before they are dealt.

Defined cases: as for `katz`; order 1 is the unigram model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .katz import BLOCK_BYTES, END, K, NO_ID, START, _read, discounted, discounts, held_out
from .shared import join_hot, stored
from .tokens import blocks, mix, run_starts, split_block

_A = np.uint64(0x9E3779B97F4A7C15)


def contexts(order: int) -> list[str]:
    return [f"h{k}" for k in range(2, order + 1)]


def occurrences(docs: DataFrame, order: int) -> DataFrame:
    """Per text its distinct n-grams: row (the text's number), held, w, h2 .. (hashes of the contexts of 1, 2, .. words), n; and a
    row per text with w null: doc_id, n (its tokens)."""
    names = contexts(order)

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        for rows in blocks(batches, BLOCK_BYTES):
            b = split_block(rows)
            texts = len(rows)
            words = np.insert(b.hashes[b.which].view(np.int64), b.starts[1:], END)
            sizes = b.sizes + 1
            text = np.repeat(np.arange(texts), sizes)
            place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            h, cols = np.zeros(len(words), np.uint64), []
            for k in range(1, order):
                before = np.full(len(words), START, np.int64)
                before[k:] = words[:-k] if k < len(words) else before[k:]
                before[place < k] = START
                h = mix(h * _A + before.view(np.uint64) + np.uint64(k))
                cols.append(h.view(np.int64))
            keys = [words, *cols[-1:], text]  # the longest context names the shorter ones
            by = np.lexsort(keys)
            first = run_starts(*(x[by] for x in keys))
            n = np.diff(np.append(first, len(by)))
            some = by[first]
            ids = rows.column("doc_id").to_numpy(zero_copy_only=False)
            held = np.fromiter(map(held_out, ids.tolist()), bool, texts)
            none = pa.nulls(texts, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(texts)), pa.array(held), pa.array(ids), none, *[none] * len(names), pa.array(sizes)], names=["row", "held", "doc_id", "w", *names, "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at + text[some]), pa.array(held[text[some]]), pa.nulls(len(some), pa.int64()), pa.array(words[some]), *[pa.array(c[some]) for c in cols], pa.array(n)],
                names=["row", "held", "doc_id", "w", *names, "n"],
            )
            at += texts

    schema = ", ".join(["row long", "held boolean", "doc_id long", "w long", *(f"{c} long" for c in names), "n long"])
    return _read(docs).mapInArrow(run, schema)


class Orders:
    """words (w, c, p1), and per order k = 2 .. : grams[k] (g, p) and alphas[k] (h, alpha); g names an n-gram, h its context."""

    def __init__(self, order, tokens, kinds, unknown, words, grams, alphas):
        self.order, self.tokens, self.kinds, self.unknown = order, tokens, kinds, unknown
        self.words, self.grams, self.alphas = words, grams, alphas


def gram(h, w):
    return F.xxhash64(h, w)


def _of_counts(grams: DataFrame) -> np.ndarray:
    counts = [F.coalesce(F.sum((F.col("c") == c).cast("long")), F.lit(0)).alias(f"n{c}") for c in range(1, K + 2)]
    return discounts(list(grams.agg(*counts).first()))


def fit(occ: DataFrame, order: int) -> Orders:
    """The model of the texts that are not held out; every counted n-gram is kept."""
    names = contexts(order)
    top = occ.where("w is not null and not held").groupBy("w", *names).agg(F.sum("n").alias("c"))
    top = stored(top, "katz-grams")
    words = stored(top.groupBy("w").agg(F.sum("c").alias("c")), "katz-words")
    d = _of_counts(words)
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds"), F.coalesce(F.sum(discounted(F.col("c"), d)), F.lit(0.0)).alias("mass")).first()
    unknown = 1.0 - total["mass"] / total.tokens if total.tokens else 1.0
    words = words.withColumn("p1", discounted(F.col("c"), d) / float(max(1, total.tokens)))
    below = words.select(F.col("w").alias("g_below"), F.col("p1").alias("p_below"))
    grams, alphas = {}, {}
    for k in range(2, order + 1):
        h = f"h{k}"
        g_below = F.col("w") if k == 2 else gram(F.col(f"h{k - 1}"), F.col("w"))
        counted = top.groupBy(*names[: k - 1], "w").agg(F.sum("c").alias("c"))
        counted = stored(counted.select(F.col(h).alias("h"), "w", "c", g_below.alias("g_below")), "katz-order")
        d = _of_counts(counted)
        # what is counted here is counted below, so the order below has its probability without backing off
        rows = join_hot(counted.withColumn("kept", discounted(F.col("c"), d)), below, "g_below")
        sums = rows.groupBy("h").agg(F.sum("c").alias("seen"), F.sum("kept").alias("kept_all"), F.sum("p_below").alias("lower"))
        full = F.col("seen") - F.col("kept_all") <= F.lit(1e-9) * F.col("seen")
        divisor = F.when(full, F.col("seen") + 1.0).otherwise(F.col("seen").cast("double"))
        rest = 1.0 - F.col("lower")
        alpha = F.when(rest > 1e-15, (1.0 - F.col("kept_all") / F.col("divisor")) / rest).otherwise(1.0)
        sums = stored(sums.withColumn("divisor", divisor).withColumn("alpha", alpha).select("h", "divisor", "alpha"), "katz-contexts")
        kept = join_hot(rows.select("h", "w", "kept"), sums.select("h", "divisor"), "h")
        grams[k] = stored(kept.select(gram(F.col("h"), F.col("w")).alias("g"), (F.col("kept") / F.col("divisor")).alias("p")), "katz-probabilities")
        alphas[k] = sums.select("h", "alpha")
        below = grams[k].select(F.col("g").alias("g_below"), F.col("p").alias("p_below"))
    return Orders(order, total.tokens, total.kinds, unknown, stored(words, "katz-unigrams"), grams, alphas)


def evaluated(rows: DataFrame, model: Orders) -> DataFrame:
    """rows (w, h2, ..) with c (the word's count, null for unknown ones) and log_p: log10 P of w after the longest context, from order 1 upwards."""
    out = join_hot(rows, model.words, "w", "left").withColumn("log_p", F.log10(F.coalesce("p1", F.lit(model.unknown)))).drop("p1")
    for k in range(2, model.order + 1):
        out = join_hot(out.withColumn("g", gram(F.col(f"h{k}"), F.col("w"))), model.grams[k], "g", "left")
        out = join_hot(out.withColumn("h", F.col(f"h{k}")), model.alphas[k], "h", "left")
        backed = F.coalesce(F.log10("alpha"), F.lit(0.0)) + F.col("log_p")
        out = out.withColumn("log_p", F.coalesce(F.log10("p"), backed)).drop("g", "p", "h", "alpha")
    return out


def score(docs: DataFrame, order: int = 3) -> DataFrame:
    """Fits on the texts that are not held out and scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    occ = stored(occurrences(docs, order), "katz-occurrences")
    model = fit(occ, order)
    rows = evaluated(occ.where("w is not null").select("row", "n", "w", *contexts(order)), model)
    base = F.log10((F.coalesce("c", F.lit(0)) + 1.0) / (model.tokens + model.kinds + 1.0))
    known = F.when(F.col("c") > 0, F.col("n")).otherwise(0)
    sums = rows.groupBy("row").agg(F.sum(known).alias("n_known"), F.sum(base * F.col("n")).alias("base_score"), F.sum(F.col("log_p") * F.col("n")).alias("score"))
    texts = occ.where("w is null").select("row", F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"))
    out = texts.join(sums, "row").withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Phrase collocations by prefix-free parsing.

Texts become runs of words with marks where a phrase can't go on. A text is cut where the hash of two
neighbouring tokens is 0 modulo `every`, so equal passages are cut alike wherever they stand; a chunk goes on
for as many words beyond its cut as a phrase can reach. Equal chunks of a language are one entry of the dictionary with
the number of times they were parsed. All counting is done on the dictionary: a phrase is counted in the chunk that owns
its first word, weighted by the chunk's frequency, so the words that two chunks share count once.

Phrases are counted one length after the other, and only those whose beginning and end, one word shorter, are frequent
themselves. Which ones are is known from a bit filter over hashes: it is built by aggregation, its size is bounded by
MOST_BITS whatever the corpus holds, and where it lets too much pass only more is counted, never less. Hashes only choose
what to count; the final counts are grouped by the words themselves. Scores are exact: decimals of 38 digits.

Defined cases: null and empty texts have no phrases; a null lang is `und`, the same as lang `und`; doc_id is not read, so null,
repeated or shared ids make no difference, and repeated rows count as occurrences of their own; a text of any length is parsed whole
(one without a cut is one chunk); of equal scores the cut after fewer words counts; other columns, whatever their
names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_order, join_hot, stored
from .token_files import spread
from .tokens import blocks, mix, plain, run_starts, word_hashes

BREAKS = r"[.,;:!?\x0A-\x0D]+"
#: Stands for breaks; no word holds it.
MARK = "."
EVERY = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Distinct hashes that a task holds before it hands them on.
HELD = 1 << 21
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, which one each token is, and each text's first token (and the end)."""
    marked = pc.replace_substring_regex(pc.ascii_lower(plain(texts)), BREAKS, f" {MARK} ")
    return _split(marked)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    lists = pc.ascii_split_whitespace(texts)
    starts = lists.offsets.to_numpy().astype(np.int64)
    flat = pc.list_flatten(lists)
    keep = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(keep)])
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), before[starts - starts[0]]


def parse(docs: DataFrame, longest: int = 5, every: int = EVERY) -> DataFrame:
    """The dictionary: lang, chunk (tokens joined by blanks), own (its first tokens, which no other chunk owns), times."""

    def run(batches):
        for b in blocks(batches):
            words, which, starts = _tokens(b.column("text"))
            n = len(which)
            if not n:
                continue
            hashes = word_hashes(words.to_pylist())[which]
            is_mark = np.append(pc.equal(words, MARK).to_numpy(zero_copy_only=False)[which], True)
            opens = np.zeros(n + 1, bool)
            opens[starts] = True
            pair = np.append(mix(hashes[:-1] * _A + hashes[1:]) % np.uint64(every) == 0, False)
            pair[:-1] &= ~opens[1:-1]  # the second word is in the same text
            cuts = np.flatnonzero(np.append(pair, True) | opens)
            first, end = cuts[:-1], cuts[1:]
            stops = np.flatnonzero(is_mark | opens)
            reach = np.minimum(end + longest - 1, stops[np.searchsorted(stops, end)])
            reach = np.where(opens[end] | is_mark[end - 1], end, reach)
            text_of = np.searchsorted(starts, first, "right") - 1
            sizes = reach - first
            tokens = words.take(pa.array(which[spread(np.arange(n), first, sizes)]))
            chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), tokens), pa.scalar(" ", pa.large_string()))
            lang = pc.fill_null(b.column("lang"), "und").take(pa.array(text_of))
            yield from pa.table({"lang": lang.cast(pa.string()), "chunk": chunks.cast(pa.string()), "own": pa.array(end - first, pa.int32())}).to_batches()

    chunks = docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, chunk string, own int")
    return chunks.groupBy("lang", "chunk", "own").agg(F.count("*").alias("times"))


PACKED = "lang string, words array<string>, which array<int>, sizes array<int>, own array<int>, times array<long>"


def packed(dictionary: DataFrame) -> DataFrame:
    """The dictionary in blocks: per block and lang its distinct tokens and its chunks as indices into them."""

    def run(batches):
        for b in blocks(batches, text="chunk"):
            lang = b.column("lang").dictionary_encode()
            of = lang.indices.to_numpy(zero_copy_only=False)
            for k, name in enumerate(lang.dictionary.to_pylist()):
                some = b.take(pa.array(np.flatnonzero(of == k)))
                words, which, starts = _split(plain(some.column("chunk")))
                one = lambda values, kind: pa.array([values], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), one(words.to_pylist(), pa.string()), one(which, pa.int32()), one(np.diff(starts), pa.int32()), one(some.column("own").to_numpy(), pa.int32()), one(some.column("times").to_numpy(), pa.int64())],
                    names=["lang", "words", "which", "sizes", "own", "times"],
                )

    return dictionary.mapInArrow(run, PACKED)


class Chunks:
    """One packed block: tokens, their hashes by language, weights of owned tokens, and how far phrases can go."""

    def __init__(self, row: pa.RecordBatch, k: int):
        flat = lambda name: row.column(name).slice(k, 1).flatten()
        self.lang = row.column("lang")[k].as_py()
        self.words = flat("words")
        self.which = flat("which").to_numpy().astype(np.int64)
        sizes, own, times = (flat(c).to_numpy().astype(np.int64) for c in ("sizes", "own", "times"))
        n = len(self.which)
        ends = np.cumsum(sizes)
        stops = np.append(pc.equal(self.words, MARK).to_numpy(zero_copy_only=False)[self.which], True)
        self.is_word = ~stops[:-1]
        stops[ends] = True
        ahead = np.flatnonzero(stops)  # marks and ends of chunks; a token's room goes to the first one after it
        self.room = np.where(self.is_word, np.repeat(ahead, np.diff(ahead, prepend=0))[:n] - np.arange(n), 0)
        inside = np.arange(n) - np.repeat(ends - sizes, sizes)
        self.weight = np.where(inside < np.repeat(own, sizes), np.repeat(times, sizes), 0)

    def starts(self, k: int) -> np.ndarray:
        """Owned places where a phrase of k words begins."""
        return np.flatnonzero((self.room >= k) & (self.weight > 0))


def gram_hashes(lang: str, words: list[str]) -> np.ndarray:
    return mix(word_hashes(words) + mix(word_hashes([lang])) * _B)


def longer(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of k words that begin at places `at`."""
    out = hashes[at]
    for i in range(1, k):
        out = mix(out * _A + hashes[at + i] + np.uint64(i))
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1


def bit_filter(found: DataFrame) -> np.ndarray:
    """found (h long) -> a bit per hash, MOST_BITS at most: 8 MB that are summed up by word of 64 bits before they are collected."""
    n = found.count()
    size = LEAST_BITS
    while size < MOST_BITS and size < 32 * n:
        size *= 2
    place = F.col("h").bitwiseAND(F.lit(size - 1))
    words = found.groupBy(F.shiftright(place, 6).cast("int").alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    table, bits = words.toArrow(), np.zeros(size // 64, np.uint64)
    bits[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return bits


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    at = run_starts(keys)
    return keys[at], np.add.reduceat(weights[order], at) if len(at) else weights[:0]


def count_words(blocks_: DataFrame) -> DataFrame:
    """Per language and word its occurrences; MARK stands for all of a language's words together."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                c = Chunks(b, k)
                at = c.starts(1)
                n = np.zeros(len(c.words), np.int64)
                np.add.at(n, c.which[at], c.weight[at])
                some = np.flatnonzero(n)
                words = pa.concat_arrays([c.words.take(pa.array(some)), pa.array([MARK])])
                yield pa.RecordBatch.from_arrays([pa.array([c.lang] * len(words), pa.string()), words, pa.array(np.append(n[some], n.sum()))], names=["lang", "phrase", "n"])

    return blocks_.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def _chain(c: Chunks, longest: int, filters: list[np.ndarray]):
    """(k, places, hashes) of owned phrases of k = 2, 3, .. `longest` words whose beginning and end, one word shorter, passed."""
    words = gram_hashes(c.lang, c.words.to_pylist())
    hashes, known = words[c.which], passes(filters[0], words)[c.which]
    at = c.starts(2)
    at = at[known[at] & known[at + 1]]
    for k in range(2, longest + 1):
        if k > 2:  # the beginning passed in the round before
            at = at[c.room[at] >= k]
            at = at[passes(filters[k - 2], longer(hashes, at + 1, k - 1))]
        found = longer(hashes, at, k)
        yield k, at, found
        if k < longest:
            at = at[passes(filters[k - 1], found)]


def count_hashes(blocks_: DataFrame, k: int, filters: list) -> DataFrame:
    """Occurrences by hash of the phrases of k words whose beginning and end passed: h, n."""

    def run(batches):
        held, bits = [], [f.value for f in filters]

        def merged():
            return _sums(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))

        def batch(h, n):
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

        for b in batches:
            for r in range(b.num_rows):
                c = Chunks(b, r)
                *_, (_, at, found) = _chain(c, k, bits)
                held.append(_sums(found, c.weight[at]))
                if sum(len(h) for h, _ in held) > HELD:
                    h, n = merged()
                    held = [(h, n)]
                    if len(h) > HELD // 2:
                        yield batch(h, n)
                        held = []
        if held:
            yield batch(*merged())

    return blocks_.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def count_phrases(blocks_: DataFrame, longest: int, filters: list) -> DataFrame:
    """Occurrences of the phrases of 2 to `longest` words that pass all filters, by their words: lang, phrase, a."""

    def run(batches):
        bits = [f.value for f in filters]
        for b in batches:
            for r in range(b.num_rows):
                c = Chunks(b, r)
                width = len(c.words)
                for k, at, found in _chain(c, longest, bits):
                    at = at[passes(bits[k - 1], found)]
                    if not len(at):
                        break
                    code = c.which[at]
                    for i in range(1, k):  # codes of whole phrases, without hashes
                        code = np.unique(code * width + c.which[at + i], return_inverse=True)[1]
                    order = np.argsort(code, kind="stable")
                    first = run_starts(code[order])
                    n = np.add.reduceat(c.weight[at][order], first)
                    head = at[order][first]
                    tokens = c.words.take(pa.array(c.which[(head[:, None] + np.arange(k)).ravel()]))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(head) + 1) * k, pa.int32()), tokens)
                    yield pa.RecordBatch.from_arrays([pa.array([c.lang] * len(head), pa.string()), pc.binary_join(lists, " "), pa.array(n)], names=["lang", "phrase", "n"])

    return blocks_.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, every: int = EVERY) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `longest` words with `least` occurrences or more (lang, phrase, a), and each language's words (lang, n)."""
    spark = docs.sparkSession
    dictionary = stored(packed(parse(docs, longest, every)), "phrases-dictionary")
    words = stored(count_words(dictionary).where((F.col("a") >= least) | (F.col("phrase") == MARK)), "phrases-words")
    single = words.where(F.col("phrase") != MARK)

    def hashed(batches):
        for b in batches:
            lang, names = b.column("lang").dictionary_encode(), b.column("phrase")
            of, h = lang.indices.to_numpy(zero_copy_only=False), np.zeros(b.num_rows, np.uint64)
            for k, name in enumerate(lang.dictionary.to_pylist()):
                some = np.flatnonzero(of == k)
                h[some] = gram_hashes(name, names.take(pa.array(some)).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    filters = [spark.sparkContext.broadcast(bit_filter(single.select("lang", "phrase").mapInArrow(hashed, "h long")))]
    for k in range(2, longest + 1):
        found = stored(count_hashes(dictionary, k, filters).where(F.col("n") >= least).select("h"), "phrases-frequent")
        filters.append(spark.sparkContext.broadcast(bit_filter(found)))
    several = count_phrases(dictionary, longest, filters).where(F.col("a") >= least)
    sizes = words.where(F.col("phrase") == MARK).select("lang", F.col("a").alias("n"))
    return stored(single.unionByName(several), "phrases"), sizes


def _joined(words, start, size):
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int | None = 2000, every: int = EVERY) -> DataFrame:
    """Phrases of 2 to `longest` words by how much more often they occur than their parts: lang, rank, phrase, a, l, r, n, score.

    Phrases inside a longer one with at least `share` percent of their occurrences go. Each language's first
    `top` stay, all for None; ranks count from 1 in a language."""
    phrases, sizes = frequent_phrases(docs, least, longest, every)
    ws, k = F.split("phrase", " "), F.size(F.split("phrase", " "))
    candidates = phrases.where(k > 1)
    part = lambda c: phrases.select("lang", F.col("phrase").alias(c), F.col("a").alias(f"f_{c}"))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), k - 1)))
    cuts = cuts.withColumns({"head": _joined(ws, F.lit(1), F.col("cut")), "tail": _joined(ws, F.col("cut") + 1, k - F.col("cut"))})
    cuts = join_hot(join_hot(join_hot(cuts, part("head"), ["lang", "head"]), part("tail"), ["lang", "tail"]), sizes, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)").cast("decimal(38,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(38,0)") * big("a") * big("n"), big("f_head") * big("f_tail"))
    lowest = F.min(F.struct(score.cast("long").alias("score"), F.col("cut"), F.col("f_head").alias("l"), F.col("f_tail").alias("r"))).alias("low")
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), lowest).select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    inner = candidates.withColumn("size", F.explode(F.filter(F.sequence(F.lit(1), k - 1), lambda s: s > 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), k - F.col("size") + 1)))
    inner = inner.groupBy("lang", _joined(ws, F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("_longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < share * F.col("a"))).drop("_longer")
    # places in one order over all languages, from range partitions: no task ranks a language whole
    placed = in_order(kept, ["lang", F.col("score").desc(), F.col("a").desc(), "phrase"], "phrases-order")
    first = placed.groupBy("lang").agg(F.min("position").alias("_first"))
    ranked = join_hot(placed, first, "lang").withColumn("rank", F.col("position") - F.col("_first") + 1)
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir):
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
sized AS (SELECT lang, ws, unnest(range(1, 6)) AS k FROM lists WHERE len(ws) > 0),
placed AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM sized WHERE len(ws) >= k),
counted AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM placed GROUP BY ALL),
sizes AS (SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM counted WHERE k > 1 AND a >= 100),
cuts AS (
  SELECT lang, k, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
scores AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, h.a AS l, t.a AS r, s.n, ((1000::HUGEINT * c.a * s.n) // (h.a::HUGEINT * t.a))::BIGINT AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail JOIN sizes s ON s.lang = c.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (
  SELECT lang, array_to_string(ws[start:start + size - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS start FROM (SELECT *, unnest(range(2, k)) AS size FROM candidates)) GROUP BY ALL),
kept AS (
  SELECT l.* FROM lowest l LEFT JOIN inner_parts i ON i.lang = l.lang AND i.phrase = l.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * l.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

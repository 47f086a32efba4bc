import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewheel.llm import katz


def tokens(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x] + [None]


def held(d):
    return zlib.crc32(str(d).encode()) % 7 == 2


class Brute:
    def __init__(self, rows):
        self.uni, self.bi, self.ctx = Counter(), Counter(), Counter()
        for d, t in rows:
            if held(d):
                continue
            h = "<s>"
            for w in tokens(t):
                self.uni[w] += 1
                self.bi[h, w] += 1
                self.ctx[h] += 1
                h = w
        self.n = sum(self.uni.values())
        self.d1, self.d2 = (self.discounts(Counter(x.values())) for x in (self.uni, self.bi))
        self.unknown = 1 - sum(self.d(self.d1, c) * c for c in self.uni.values()) / self.n if self.n else 1.0
        self.kept = defaultdict(dict)
        for (h, w), c in self.bi.items():
            if c >= 2:
                self.kept[h][w] = c

    @staticmethod
    def discounts(n):
        common = 6 * n[6] / n[1] if n[1] else 1
        out = {}
        for c in range(1, 6):
            d = ((c + 1) * n[c + 1] / (c * n[c]) - common) / (1 - common) if n[c] and n[c + 1] and common < 1 else 0
            out[c] = d if 0 < d < 1 else (c - 0.5) / c
        return out

    @staticmethod
    def d(ds, c):
        return ds.get(c, 1.0)

    def p1(self, w):
        c = self.uni[w]
        return self.d(self.d1, c) * c / self.n if c else self.unknown

    def p2(self, h, w):
        total = self.ctx[h]
        if not total:
            return self.p1(w)
        kept = self.kept.get(h, {})
        mass = sum(self.d(self.d2, c) * c for c in kept.values())
        div = total + 1 if total - mass <= 1e-9 * total else total
        if w in kept:
            return self.d(self.d2, kept[w]) * kept[w] / div
        rest = 1 - sum(self.p1(x) for x in kept)
        return (1 - mass / div) / rest * self.p1(w)

    def row(self, d, t):
        ts, s, base, h = tokens(t), 0.0, 0.0, "<s>"
        for w in ts:
            s += math.log10(self.p2(h, w))
            base += math.log10((self.uni[w] + 1) / (self.n + len(self.uni) + 1))
            h = w
        return held(d), len(ts), sum(self.uni[w] > 0 for w in ts), self.n, base, s


def compare(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    brute = Brute(rows)
    got = sorted(katz.score(docs, katz.fit(docs)).collect(), key=lambda r: r.doc_id)
    for (d, t), r in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        want = brute.row(d, t)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (d, *want[:4])
        assert r.base_score == pytest.approx(want[4]) and r.score == pytest.approx(want[5])
    return brute, got


def test_documents(spark, sf):
    brute, got = compare(spark, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    for h in list(brute.ctx)[:30]:  # exactly normalised: known words, the end and the unknown word
        total = sum(brute.p2(h, w) for w in brute.uni) + brute.p2(h, "\0")
        assert total == pytest.approx(1)


def test_odd_rows(spark):
    texts = ["", None, "a b a b a b", "A  b\na b", "a", "x y z " * 40, "\t", "b a b a c c c c d e f g h"] * 4
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(texts)], "doc_id long, text string, c int, word string")
    compare(spark, docs.repartition(3))


def test_null_ids_are_training_texts(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in katz.score(docs, katz.fit(docs, 1)).collect()}
    assert set(got) == {None, 1, 2} and not got[None].held_out
    n = 4 + sum(len(tokens(t)) for d, t in ((1, "a b"), (2, None)) if not held(d))
    assert {r.train_tokens for r in got.values()} == {n} and got[None].n_known == got[None].n_tokens == 4


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(none, katz.fit(none)).count() == 0
    only = next(d for d in range(100) if held(d))
    docs = spark.createDataFrame([(only, "a b")], "doc_id long, text string")
    (r,) = katz.score(docs, katz.fit(docs)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


def test_discounts():
    d = katz.discounts([1000, 400, 200, 120, 80, 60])
    assert ((d[1:] > 0) & (d[1:] < 1)).all() and np.allclose(katz.discounts([0] * 6)[1:], [(c - 0.5) / c for c in range(1, 6)])


class Whole(Brute):
    """Keeps every bigram."""

    def __init__(self, rows):
        super().__init__(rows)
        for (h, w), c in self.bi.items():
            self.kept[h][w] = c


def test_operator_keeps_bigrams_seen_once(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    whole, pruned = Whole(rows), Brute(rows)
    got = {r.doc_id: r.score for r in katz.op1_katz(spark, sf).collect()}
    want = {d: whole.row(d, t)[-1] for d, t in rows}
    assert got == pytest.approx(want)
    assert any(abs(want[d] - pruned.row(d, t)[-1]) > 1 for d, t in rows)
    for h in list(whole.ctx)[:30]:
        assert sum(whole.p2(h, w) for w in whole.uni) + whole.p2(h, "\0") == pytest.approx(1)


def test_packed_arrays_come_back_whole():
    rng = np.random.default_rng(3)
    top = np.iinfo(np.int64).max
    cases = [np.sort(rng.integers(-top, top, 999)), np.array([-top - 1, top]), rng.integers(0, 1 << 16, 500).astype(np.uint16), np.array([4294967295, 0, 7], np.uint32), np.zeros(0, np.int64)]
    for x in cases:
        for ascending in (False, True):
            back = katz._unpack(pa.scalar(katz._pack(x, ascending), pa.binary()), x.dtype, ascending)
            assert back.dtype == x.dtype and np.array_equal(back, x)

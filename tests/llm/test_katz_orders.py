"""Katz models of order 1 to 4 against dictionaries, and order 2 against the packed operator."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tidewheel.llm import katz, katz_orders


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


class Brute:
    def __init__(self, texts, order):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for t in texts:
            tokens = ["<s>"] * (order - 1) + words_of(t) + ["</s>"]
            for i in range(order - 1, len(tokens)):
                for k in range(1, order + 1):
                    self.counts[k][tuple(tokens[i - k + 1 : i + 1])] += 1
        self.n = sum(self.counts[1].values())
        self.d = [None] + [katz.discounts([sum(c == j for c in self.counts[k].values()) for j in range(1, katz.K + 2)]) for k in range(1, order + 1)]
        self.after = [defaultdict(dict) for _ in range(order + 1)]
        for k in range(2, order + 1):
            for g, c in self.counts[k].items():
                self.after[k][g[:-1]][g[-1]] = c
        self.unknown = 1 - sum(self.kept(1, c) for c in self.counts[1].values()) / self.n if self.n else 1.0

    def kept(self, k, c):
        return c * (1.0 if c > katz.K else self.d[k][c])

    def p(self, h, w):
        k = len(h) + 1
        if k == 1:
            c = self.counts[1][(w,)]
            return self.kept(1, c) / self.n if c else self.unknown
        seen = self.after[k].get(h)
        if not seen:
            return self.p(h[1:], w)
        total, mass = sum(seen.values()), sum(self.kept(k, c) for c in seen.values())
        divisor = total + 1 if total - mass <= 1e-9 * total else total
        if w in seen:
            return self.kept(k, seen[w]) / divisor
        rest = 1 - sum(self.p(h[1:], x) for x in seen)
        return ((1 - mass / divisor) / rest if rest > 1e-15 else 1.0) * self.p(h[1:], w)

    def score(self, text):
        tokens = ["<s>"] * (self.order - 1) + words_of(text) + ["</s>"]
        return sum(math.log10(self.p(tuple(tokens[i - self.order + 1 : i]), tokens[i])) for i in range(self.order - 1, len(tokens)))


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = "the of a In on cat dog sat ran mat state x1 état".split()
    docs = [(i, " ".join(r.choices(vocabulary, weights=range(13, 0, -1), k=r.randint(0, 40)))) for i in range(n)]
    return docs + [(None, "the cat sat"), (None, None), (n, ""), (n + 1, "the cat sat on the mat " * 30), (n + 1, "the cat sat on the mat " * 30), (n + 2, "unheard words only"), (n + 3, " \t\n")]


@pytest.mark.parametrize("order", [1, 3])
def test_scores_equal_dictionaries(spark, order):
    docs = corpus(order)
    brute = Brute([t for i, t in docs if i is None or not katz.held_out(i)], order)
    table = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, w int, h2 string").repartition(3)
    got = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in katz_orders.score(table, order).collect())
    assert got == sorted((str(i), len(words_of(t)) + 1, round(brute.score(t), 6)) for i, t in docs)


def test_every_context_sums_to_one():
    brute = Brute([t for _, t in corpus(9)], 3)
    words = [g[0] for g in brute.counts[1]]
    for h in [*list(brute.after[3])[:80], ("the", "nowhere"), ("no", "where"), ("<s>", "<s>")]:
        assert sum(brute.p(h, w) for w in words) + brute.p(h, "in no text") == pytest.approx(1)


def test_order_two_is_the_packed_operator(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: r for r in katz_orders.score(docs, 2).collect()}
    for r in katz.score(docs, katz.fit(docs, least=1)).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (one[r.doc_id].held_out, one[r.doc_id].n_tokens, one[r.doc_id].n_known, one[r.doc_id].train_tokens)
        assert r.score == pytest.approx(one[r.doc_id].score) and r.base_score == pytest.approx(one[r.doc_id].base_score)


def test_trigrams_help_on_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    per_token = {k: katz_orders.score(docs, k).where("held_out").selectExpr("sum(score) / sum(n_tokens)").first()[0] for k in (1, 3)}
    assert per_token[3] > per_token[1]


def test_empty_table(spark):
    assert katz_orders.score(spark.createDataFrame([], "doc_id long, text string"), 3).count() == 0

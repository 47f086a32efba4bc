"""Spelling variants against all pairs of words and a plain count of runs."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidewheel.llm import spelling


def brute_words(docs):
    c = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_groups(words):
    def less(w):
        return {w[:k] + w[k + 1 :] for k in range(len(w))}

    by, out = {}, {}
    for w in words:
        for key in less(w) | {w}:
            by.setdefault(key, set()).add(w)
    near = {w: {x for key in less(w) | {w} for x in by[key] if is_near(w, x)} for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [w, form, w, n, len(near[w]), words[form] if form else None]
    for row in out.values():
        while out[row[2]][1]:
            row[2] = out[row[2]][1]
    return sorted(map(tuple, out.values()))


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("span", [1, 2])
def test_groups_of_random_words(spark, span):
    r = random.Random(span)
    words = {"".join(r.choice("abé") for _ in range(r.randint(7, 10))): r.choice([2, 3, 25, 400, 4000, 40000]) for _ in range(500)}
    words |= {"x" * 40: 1000, "x" * 41: 5, "x" * 39 + "y": 5, "y" + "x" * 39: 100, "x" * 20 + "z" + "x" * 20: 7, "q" * 700: 3, "q" * 699: 300, "q" * 300 + "w" + "q" * 399: 3}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert rows(spelling.group(table, span=span)) == brute_groups(words)


def test_small_tiles_hold_whole_keys(spark, monkeypatch):
    r = random.Random(9)
    words = {"prefix" + "".join(r.choice("abcdefghij") for _ in range(2)) + "suffix": r.randint(2, 90) for _ in range(300)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    monkeypatch.setattr(spelling, "CELLS", 64)
    assert rows(spelling.group(table)) == brute_groups(words)


def test_counting_and_edge_cases(spark):
    r = random.Random(3)
    pool = ["Straßenbahn", "strassenbahn", "ÀÉÎõüÿÀ", "notation", "Notations", "short", "abc×defghij÷klmnopqr", "naïvely-written", "x" * 5000]
    docs = [(r.choice([1, 2, 2**53 + 1, None]), " ".join(r.choice(pool) for _ in range(r.randint(0, 60)))) for _ in range(200)] + [(5, None), (6, ""), (7, "1234567 !!"), (8, "notations" * 3000)]
    table = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    words = brute_words(docs)
    assert {w.word: w.n for w in spelling.count_words(table).collect()} == words
    assert rows(spelling.group(spelling.count_words(table))) == brute_groups(words)
    assert spelling.group(spelling.count_words(table.limit(0))).count() == 0


def test_chains_and_ties(spark):
    words = {"aaaaaaab": 2, "aaaaaaac": 20, "aaaaaadc": 200, "aaaaaedc": 2000, "aaaafedc": 20000, "zzzzzzza": 30, "zzzzzzzb": 30, "zzzzzzzc": 3}
    got = {r.word: r for r in spelling.group(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["aaaaaaab"].root == got["aaaaaedc"].root == "aaaafedc"
    assert got["zzzzzzzc"].form == "zzzzzzza" and got["zzzzzzzb"].form is None
    with pytest.raises(ValueError):
        spelling.roots(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "word string, form string"), rounds=4)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(spelling.op11_spelling(spark, sf)) == brute_groups(brute_words(docs))

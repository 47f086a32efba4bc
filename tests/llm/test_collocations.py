"""Collocations against counting all n-grams, and the SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tidewheel.llm import collocations as C


def brute(docs, least, longest=5, top=2000, share=100):
    f, size = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cands = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    gone = {(lang, w[s : s + z]) for (lang, w), a in cands.items() for z in range(2, len(w)) for s in range(len(w) - z + 1) if 100 * a >= share * f[lang, w[s : s + z]]}
    out = {}
    for (lang, w), a in cands.items():
        if (lang, w) not in gone:
            cut = min(((1000 * a * size[lang]) // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-cut[0], -a, " ".join(w).encode(), f[lang, w[: cut[1]]], f[lang, w[cut[1] :]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, size[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n=300):
    r = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "état", "中文", "x-y", "a", "b", "c d", "\x1c", "<s>"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "!?", " : ", "\x0b"]
    passage = "one two three four five six seven eight nine ten in the new york city hall of the state"
    docs = [("".join(r.choice(words) + r.choice(marks) for _ in range(r.randint(0, 60))) + r.choice(["", passage]), r.choice(["en", "de", None, "und"])) for _ in range(n)]
    return docs + [(None, "en"), ("", None), (" .,; \n", "en"), ("same " * 3000, "fr"), ("ab cd " * 2000, "fr"), (" ".join(f"w{i % 977}" for i in range(9000)), "fr")]


@pytest.mark.parametrize("every", [2, 16])
def test_equals_all_n_grams(spark, every):
    docs = texts(every)
    table = spark.createDataFrame([(t, g, "p", 7) for t, g in docs], "text string, lang string, phrase string, n int").repartition(4)
    assert rows(C.collocations(table, least=9, every=every)) == brute(docs, 9)


def test_lengths_shares_and_tops(spark):
    docs = texts(7)
    table = spark.createDataFrame(docs, "text string, lang string")
    assert rows(C.collocations(table, least=5, longest=3, share=60, top=4)) == brute(docs, 5, 3, 4, 60)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    docs = texts(8, 100)
    table = spark.createDataFrame(docs, "text string, lang string")
    monkeypatch.setattr(C, "LEAST_BITS", 64)
    monkeypatch.setattr(C, "MOST_BITS", 64)
    monkeypatch.setattr(C, "HELD", 50)
    assert rows(C.collocations(table, least=3)) == brute(docs, 3)


def test_dictionary_counts_parses(spark):
    text = " ".join(f"w{i}" for i in range(400))
    table = spark.createDataFrame([(text, "en")] * 6 + [("other " + text, "en")], "text string, lang string")
    found = C.parse(table).collect()
    assert sum(r.own * r.times for r in found) == 400 * 7 + 1
    assert max(r.times for r in found) == 7 and len(found) < 60


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert rows(C.op13_collocations(spark, sf)) == sorted(con.execute(C.ORACLE).fetchall())

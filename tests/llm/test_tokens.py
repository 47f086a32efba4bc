import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import byte_bpe, prefix_counts

TEXTS = ["", None, "a", " ", "Hello  world's end\n\n  x", "<|endoftext|>a <|endoftext|>", "x" * 3000, "wörter über ñ 漢字 12 345 …", "a\tb \r\n c", "Th" * 500 + " " + "é" * 90]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(1, None, "x")], "doc_id long, text string, ids string")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(prefix_counts.vocabulary())


def test_counts_equal_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    lib = library()
    got = {r.doc_id: r for r in prefix_counts.op9_token_counts(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        n = len(lib.encode(d.text or "", add_special_tokens=False).ids)
        r = got[d.doc_id]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((d.text or "").encode()), n > 512)


def test_odd_texts(spark):
    lib = library()
    for r in prefix_counts.budget_report(rows(spark)).collect():
        t = TEXTS[r.doc_id] or ""
        assert r.n_tokens == len(lib.encode(t, add_special_tokens=False).ids)
    assert prefix_counts.budget_report(rows(spark, [])).count() == 1
    tables = prefix_counts.prefix_tables(rows(spark)).collect()
    assert all((r.piece_counts or [0])[-1] == r.n_tokens for r in tables)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abthe n'sl12 \n<é漢!"), max_size=24))
def test_every_prefix(text):
    lib, c = library_once(), prefix_counts.counter(prefix_counts.vocabulary())
    table, pieces = c.table(text), c.parts_of(text)
    assert len(table) == len(text.encode()) + 1
    before = tokens_before = 0
    for p in pieces:  # of any kind: the merges of a prefix of a piece are those of its bytes alone
        for k in range(1, len(p) + 1):
            alone = lib.model.tokenize("".join(BYTES[x] for x in p[:k].encode()))
            assert table[before + len(p[:k].encode())] == tokens_before + len(alone)
        before, tokens_before = before + len(p.encode()), tokens_before + len(lib.encode(p, add_special_tokens=False).ids)
    for limit in range(6):
        size, n, cut = c.budget(text, limit)
        assert (size, n) == (len(text.encode()), tokens_before) and cut == c.longest_within(text, limit)


BYTES = {b: s for s, b in prefix_counts._byte_chars().items()}
_LIB = []


def library_once():
    if not _LIB:
        _LIB.append(library())
    return _LIB[0]


def test_longest_within():
    c = prefix_counts.counter(prefix_counts.vocabulary())
    text = "the quick é brown fox jumps"
    for budget in range(9):
        cut = c.longest_within(text, budget)
        assert c.table(text)[cut] <= budget
        text.encode()[:cut].decode()


def test_memory_is_bounded():
    c = prefix_counts.PrefixCounter(prefix_counts.vocabulary(), remember=50)
    lib = library_once()
    for i in range(400):
        text = f"wörd{i} {i * i} zq{i}x"
        assert c.budget(text, 512)[1] == len(lib.encode(text, add_special_tokens=False).ids)
        assert len(c.known) <= 50 and len(c.apart) <= 50


def test_empty_tables_and_texts_without_blanks(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    for f in (prefix_counts.budget_report, prefix_counts.prefix_tables, byte_bpe.digests, byte_bpe.with_ids):
        assert f(none).count() == 0
    text = "漢字かな" * 40_000  # longer than a piece, without a safe place
    enc = byte_bpe.encoding(byte_bpe.rank_file(), byte_bpe.pattern())
    assert byte_bpe.encode(text, enc) == enc.encode_ordinary(text)


def test_encode_round_trip(spark):
    enc = byte_bpe.encoding(byte_bpe.rank_file(), byte_bpe.pattern())
    for r in byte_bpe.digests(rows(spark)).collect():
        t = TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    both = byte_bpe.with_bytes(byte_bpe.with_ids(rows(spark)))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both.collect())


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab1 \n\t'sé.  "), max_size=200))
def test_safe_pieces(text):
    enc = byte_bpe.encoding(byte_bpe.rank_file(), byte_bpe.pattern())
    assert byte_bpe.encode(text, enc, 5) == enc.encode_ordinary(text)
    assert "".join(byte_bpe.safe_pieces(text, 5)) == text

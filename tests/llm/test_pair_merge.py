"""The pair occurrence index against the tokenizers library."""

import hashlib
import random
import struct

import pyarrow as pa
import pytest

from tidewheel.llm import pair_merge

PARTS = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'l", "'v", "'ve", "a", "B", "é", "1", "²", "½", "!", '"', "the", "ing", " ", "　", "中文", "\U0001f642", "́", "<|endoftext|>", "<|endo", "\x1c", "\x00", "aaaaaaa", "hehehe", "\r", "_", "՘"]
FIXED = [None, "", " ", "  ", "\n", " 's", "''", "'s's", "x\n's", "a  's", "'r", "'re", "'rest", "don't we'll I'd'v", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "a" * 5000 + "ab" * 3000 + "hehe" * 2000, "x " + "é" * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pair_merge.vocabulary())


def texts_of(seed, n=400):
    r = random.Random(seed)
    return FIXED + ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False).encode())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ids_equal_the_library(library, seed):
    texts = texts_of(seed)
    ids, counts = pair_merge.pair_index(pair_merge.vocabulary()).encode(pa.array(texts, pa.string()))
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)
        at += n
    assert at == len(ids)


def test_sliced_arrays(library):
    texts = pa.array(["skip me", *texts_of(4, 20), "and me"]).slice(1, len(FIXED) + 20)
    ids, counts = pair_merge.pair_index(pair_merge.vocabulary()).encode(texts)
    assert ids.tolist() == [i for t in texts.to_pylist() for i in library.encode(t or "", add_special_tokens=False).ids]
    assert len(counts) == len(texts)


def test_digests(spark, library):
    texts = texts_of(5, 60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (0, "same id"), (0, "same id")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int").repartition(5)
    for block in (pair_merge.BLOCK_BYTES, 100):
        got = sorted((tuple(r) for r in pair_merge.digests(docs, block=block).collect()), key=str)
        assert got == sorted(((i, *expected(library, t)) for i, t in rows), key=str)
    assert pair_merge.digests(docs.limit(0)).count() == 0


def test_columns_round_trip(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts_of(6, 50))] + [(None, "x")], "doc_id long, text string")
    both = pair_merge.with_text(pair_merge.with_ids(docs))
    for r in both.collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    broken = spark.createDataFrame([([int(pair_merge.pair_index(pair_merge.vocabulary()).byte[0xE4])],), (None,)], "ids array<int>")
    assert sorted(r.decoded for r in pair_merge.with_text(broken).collect()) == ["", "�"]


def test_query(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pair_merge.op12_pair_merge(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, docs[r.doc_id])

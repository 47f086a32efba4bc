import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import token_files
from tidewheel.llm.shared import new_folder
from tidewheel.llm.tokens import blocks, record_group, split_block, word_hashes


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_slices_keep_their_words():
    rng = np.random.default_rng(3)
    texts = [None if i % 97 == 0 else " ".join(rng.choice(["Él", "ÄB", "x", "漢字", "q" * 40, "\n"], rng.integers(0, 30))) for i in range(4000)]
    batches = pa.table({"doc_id": range(4000), "text": pa.array(texts)}).to_batches(max_chunksize=1500)
    got, n = [], 0
    for rows in blocks(batches, size=20_000):
        b = split_block(rows)
        words = b.hashes[b.which]
        for i, d in enumerate(rows.column("doc_id").to_pylist()):
            want = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(texts[d])) if x]
            assert (words[b.starts[i] : b.starts[i + 1]] == word_hashes(want)).all()
            assert b.starts[i + 1] - b.starts[i] == len(want)
        got += rows.column("doc_id").to_pylist()
        n += 1
    assert got == list(range(4000)) and n > 10


def test_sliced_blocks_encode_as_the_library_does():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(token_files.vocabulary())
    texts = pa.array(["Éa b", "x ÄÖ z", None, "漢 é", "last One"] * 50)
    for at in (0, 7, 101):
        ids, counts = token_files.encode_block(texts.slice(at, 90), token_files.Words(lib), 1)
        want = [[*lib.encode(t or "", add_special_tokens=False).ids, 1] for t in texts.slice(at, 90).to_pylist()]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


_WORDS = []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abTHEJ'snl12 \n<|>./,;-éÉĲŉİΣςß漢か\u030c\u0307\x1c\x85\xa0\xad½²_"), max_size=14), min_size=1, max_size=6), st.booleans())
def test_words_equal_the_library(texts, crowded):
    if not _WORDS:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(token_files.vocabulary())
        _WORDS.extend([lib, token_files.Words(lib), token_files.Words(lib, most=12)])
    texts = [*texts, "<|endoftext|>x </w> a</w>b it's <|ENDOFTEXT|>", None]
    ids, counts = token_files.encode_block(pa.array(texts), _WORDS[1 + crowded], 1)
    want = [[*_WORDS[0].encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_records_of_first_blocks_spread():
    for groups in (64, 211, 16):
        used = {record_group(part, 0, groups) for part in range(32)}
        assert len(used) > 8 and used <= set(range(groups))


@pytest.mark.parametrize("shuffled", [16, 64])
def test_dealt_document_records_fill_many_groups(spark, shuffled):
    from tidewheel.llm import jaccard, katz

    docs = spark.range(320).selectExpr("id as doc_id", "concat('some words of text number ', id) as text", "id as text_key").repartition(32)
    for rows in (docs.mapInArrow(jaccard._deal(shuffled), jaccard._DEALT), docs.mapInArrow(katz._deal_scores(np.zeros(0, np.uint64), shuffled), katz._DEALT)):
        groups = rows.where("bucket < 0").groupBy("bucket").count().collect()
        assert len(groups) > 8 and sum(r["count"] for r in groups) == 32


def test_null_ids_leave_other_ids_alone(spark):
    rows = [(2**53 + 1, "a"), (None, "b c"), (-(2**63), "d"), (None, None), (7, "a")] + [(2**60 + i, "x") for i in range(40)]
    folder = new_folder(spark, "null-ids")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), folder, parts=4)
    got = token_files.read_documents(spark, folder).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)][:2] == [None, None]

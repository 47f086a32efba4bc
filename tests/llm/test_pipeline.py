import hashlib
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_jaccard import brute as near_brute
from tests.llm.test_quality import brute as measures
from tests.llm.test_tables import check_mix
from tidewheel.llm import byte_bpe, mixing, quality


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_key string, failed_bits string"
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "mine", "mine") for d, t, s in rows], schema)


def test_texts_under_one_doc_id(spark):
    docs = documents(spark, [(5, "alpha", "a"), (5, "beta", "a"), (9, "Beta", "a"), (None, "gamma", None), (None, "delta", None), (7, "x", "b"), (7, "X", "b"), (2, None, "c"), (3, "", "c")])
    kept = corpus_pipeline.exact_duplicates(spark, docs, None)
    got = sorted((str(r.doc_id), (r.text or "").lower()) for r in kept.collect())
    assert got == sorted([("5", "alpha"), ("9", "beta"), ("None", "gamma"), ("None", "delta"), ("7", "x"), ("3", "")])
    assert kept.columns == docs.columns
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z "
    docs = documents(spark, [(5, t + "1", "a"), (5, "beta " * 9, "a"), (3, t, "a"), (None, t + "2", None), (8, None, None)])
    kept = corpus_pipeline.near_duplicates(spark, docs, None)
    assert sorted((r.doc_id, (r.text or "")[:4]) for r in kept.collect()) == [(3, "a b "), (5, "beta"), (8, "")]
    docs = documents(spark, [(5, "a b c", "a"), (5, "d e f", "b"), (5, "d e f", "b"), (None, "g h", None)] * 2)
    mixed = corpus_pipeline.mix_sources(spark, docs, None)
    n = {(r.source, r.doc_id): sum(x.copies for x in mixing.mix(docs).collect() if (x.source, x.doc_id) == (r.source, r.doc_id)) for r in docs.collect()}
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.source, r.doc_id] += 1
    assert dict(got) == {k: v for k, v in n.items() if v}


def test_empty_table(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.count() == 0 and out.columns == docs.columns
    assert corpus_pipeline.encode(spark, docs, None).count() == 0


def test_stages_one_after_the_other(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.where("doc_id < 12")
    docs = docs.union(extra).union(extra.withColumn("doc_id", extra.doc_id + 10000))
    tables, columns = [docs], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, tables[-1], sf).write.parquet(path)
        tables.append(spark.read.parquet(path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert tables[-1].columns == columns
    rows = [t.collect() for t in tables]

    passes = lambda t: not any(eval(c, {}, dict(zip(quality.MEASURES, measures(t)))) for c in (quality.RULES[r] for r in quality.POLICIES[quality.CURRENT]))
    assert sorted(r.doc_id for r in rows[1]) == sorted(r.doc_id for r in rows[0] if passes(r.text))

    last = defaultdict(int)
    for r in rows[1]:
        last[lower(r.text)] = max(last[lower(r.text)], r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(last.values())

    near = near_brute([(r.doc_id, r.text) for r in rows[2]])
    assert sorted(r.doc_id for r in rows[3]) == sorted(d for d, _, c in near if d == c)

    mixed = mixing.mix(tables[3]).collect()
    check_mix(mixed, len(rows[3]))
    assert sorted(r.doc_id for r in rows[4]) == sorted(r.doc_id for r in mixed for _ in range(r.copies))

    texts = {r.doc_id: r.text for r in rows[4]}
    assert sorted(r.doc_id for r in rows[5]) == sorted(r.doc_id for r in rows[4])
    enc = byte_bpe.encoding(byte_bpe.rank_file(), byte_bpe.pattern())
    for r in rows[5]:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert r.n_tokens == len(enc.encode_ordinary(texts[r.doc_id]))

"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts beyond `long_chars` are cut at safe boundaries before they are encoded: between an ASCII letter or
digit and a following space or newline. No match of the pattern crosses such a place, and the look-ahead
of its white-space branch only looks at what follows, so the ids are those of the whole text; memory in
the library then follows the piece and not the text. Ids are decoded as raw bytes, which is exact for
any ids, also where a token ends within a character.

Defined cases: null counts as the empty text, which has no ids; repeated rows give repeated rows; an
empty table gives an empty result; other columns of the input are carried along.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[0-9A-Za-z])(?=[ \n])")


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def encoding(path: str, pat: str):
    """The library's encoding over a rank file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pat, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, long_chars: int = LONG_CHARS):
    """text in pieces of at least long_chars (but for the last), cut at safe boundaries."""
    at = 0
    while len(text) - at > long_chars:
        m = _SAFE.search(text, at + long_chars)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode(text: str | None, enc, long_chars: int = LONG_CHARS) -> list[int]:
    if not text:
        return []
    if len(text) <= long_chars:
        return enc.encode_ordinary(text)
    return [i for piece in safe_pieces(text, long_chars) for i in enc.encode_ordinary(piece)]


def with_ids(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pat: str | None = None, long_chars: int = LONG_CHARS) -> DataFrame:
    """docs with `out`, the token ids (array<int>) of `text`."""
    path, pat = path or rank_file(), pat or pattern()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        enc = encoding(path, pat)
        return pa.array([encode(t, enc, long_chars) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return docs.withColumn(out, ids(F.col(text)))


def with_bytes(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, pat: str | None = None) -> DataFrame:
    """docs with `out`, the raw bytes (binary) that `ids` stand for; null ids give no bytes."""
    path, pat = path or rank_file(), pat or pattern()

    @F.arrow_udf(T.BinaryType())
    def decoded(rows: pa.Array) -> pa.Array:
        enc = encoding(path, pat)
        return pa.array([enc.decode_bytes(r or []) for r in rows.to_pylist()], pa.binary())

    return docs.withColumn(out, decoded(F.col(ids)))


def digests(docs: DataFrame, path: str | None = None, pat: str | None = None, long_chars: int = LONG_CHARS) -> DataFrame:
    """Per document its ids' count and hash and the decoded bytes' hash; encodes and decodes in one pass over Arrow batches."""
    path, pat = path or rank_file(), pat or pattern()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc = encoding(path, pat)
        for b in batches:
            keys, n, a, z = b.column("doc_id"), [], [], []
            for t in b.column("text"):
                ids = encode(t.as_py(), enc, long_chars)
                n.append(len(ids))
                a.append(hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
                z.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_byte_bpe(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

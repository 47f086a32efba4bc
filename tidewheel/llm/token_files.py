"""Token ids as flat binary files with 64-bit document offsets, memory-mapped for reading.

A data set is a folder in the shared file system: for each partition `part-N.bin` (ids as little-endian
unsigned integers, 16 bits wide if the vocabulary allows, else 32) and `part-N.idx` (one record per
document: doc_id and the local end offset, both 64-bit), and `bases.json` with each partition's first
token and document, the prefix sums of the partitions' counts, and its number of null doc_ids. Partitions are ranges of doc_id, so ids
stand in ascending doc_id order over the whole set. A file is written under a name of its task attempt
and renamed when it is whole: a repeated task replaces equal bytes.

Words (runs between ASCII white space) are encoded by the library once while a worker remembers them; the
vocabulary's normaliser and splitter never join characters across white space, so the ids of a text are
those of its words in order.

Defined cases: null counts as the empty text (only the end id is written); equal doc_ids, also repeated rows,
are ordered by the hash of their texts; null doc_ids come first and are read back as null (the index holds 0 for
them, `bases.json` their number); a text of any length is one block at least; other columns of the
input, whatever their names, are not read; an empty table gives a set without documents.
"""

from __future__ import annotations

import json
import mmap
import os
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .shared import new_folder, partitions
from .tokens import blocks, plain

BLOCK_BYTES = 10 << 20
_NAME = np.dtype([("a", "<u8"), ("b", "<u8")])
_ENTRY = np.dtype([("doc_id", "<i8"), ("end", "<u8")])


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def local_path(uri: str) -> str:
    """The mounted path of a shared folder; memory-mapping needs one."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"token files are memory-mapped and need a mounted shared folder, not {uri}")
    return uri


def spread(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices flat[starts[i]:starts[i]+sizes[i]] one after the other."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)] if total else flat[:0]


class Words:
    """Ids of words, encoded by the library once and kept while fewer than `most` words are known.

    One object lives as long as its Python worker, so words are shared by the blocks of all its tasks; when it
    is full it starts again from the block at hand, which bounds its memory whatever the corpus holds.

    Plain words (printable ASCII without ' and <, and the letters of Latin-1) go to the library as one text
    with blanks between them: its splitter cuts them into a number of pieces that the same pattern counts here,
    and the last id of a piece is one of the vocabulary's word ends, so the ids fall apart into words again.
    Where the ends don't add up, and for all other words, each word is a text of its own."""

    PLAIN = r"^[\x21-\x26\x28-\x3b\x3d-\x7e\x{c0}-\x{ff}]+$"
    PIECES = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
    CHUNK = 4096

    def __init__(self, tokenizer, most: int = 1_500_000):
        self.tokenizer, self.most = tokenizer, most
        vocab = tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self):
        """Known words: 128-bit hashes in order of their first half, and where their ids are."""
        self.known = np.zeros(0, _NAME)
        self.where, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _together(self, words: list[str], pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (found,) = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != pieces.sum():
            return self._apart(words)
        return ids, np.diff(ends[np.cumsum(pieces) - 1], prepend=0)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words, in their order."""
        plain_word = pc.match_substring_regex(words, self.PLAIN).to_numpy(zero_copy_only=False)
        pieces = pc.count_substring_regex(words, self.PIECES).to_numpy(zero_copy_only=False).astype(np.int64)
        names, parts = words.to_pylist(), []
        order = np.concatenate([np.flatnonzero(plain_word), np.flatnonzero(~plain_word)])
        n_plain = int(plain_word.sum())
        for a in range(0, len(order), self.CHUNK):
            some = order[a : min(a + self.CHUNK, n_plain if a < n_plain else len(order))]
            parts.append(self._together([names[i] for i in some], pieces[some]) if a < n_plain else self._apart([names[i] for i in some]))
            if a < n_plain < a + self.CHUNK:
                rest = order[n_plain : a + self.CHUNK]
                parts.append(self._apart([names[i] for i in rest]))
        ids, sizes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        starts = (np.cumsum(sizes) - sizes)[back]
        return spread(ids, starts, sizes[back]), sizes[back]

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words -> (flat ids, start per word, size per word)."""
        names = np.frombuffer(b"".join(map(xxh3_128_digest, words.to_pylist())), _NAME)
        order = np.argsort(names["a"])
        names = names[order]
        spot = np.searchsorted(self.known["a"], names["a"])
        inside = np.minimum(spot, max(0, len(self.known) - 1))
        hit = self.known[inside] == names if len(self.known) else np.zeros(len(names), bool)
        if len(self.known) and len(self.known) + (~hit).sum() > self.most:
            self._clear()
            return self.ids_of(words)
        where = np.empty(len(names), np.int64)
        where[order[hit]] = self.where[inside[hit]]
        if not hit.all():
            new = order[~hit]
            ids, sizes = self._encode(words.take(pa.array(new)))
            where[new] = at = len(self.sizes) + np.arange(len(new))
            starts = len(self.flat) + np.cumsum(sizes) - sizes
            self.flat, self.starts, self.sizes = (np.concatenate(x) for x in ((self.flat, ids), (self.starts, starts), (self.sizes, sizes.astype(np.int32))))
            self.known, self.where = np.insert(self.known, spot[~hit], names[~hit]), np.insert(self.where, spot[~hit], at.astype(np.int32))
        return self.flat, self.starts[where], self.sizes[where]


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(_tokenizer(path))


def encode_block(texts: pa.Array, words: Words, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts and, per text, its number of ids; end_id, if any, closes each text."""
    lists = pc.ascii_split_whitespace(plain(texts))
    bounds = lists.offsets.to_numpy()
    coded = pc.list_flatten(lists).dictionary_encode()
    flat, starts, sizes = words.ids_of(coded.dictionary)
    which = coded.indices.to_numpy(zero_copy_only=False)
    per_word = sizes[which]
    ends = np.concatenate([[0], np.cumsum(per_word)])[bounds - bounds[0]]
    counts = np.diff(ends)
    starts = starts[which]
    if end_id is not None:  # one more word of one id after each text
        flat = np.append(flat, np.uint32(end_id))
        starts, per_word = np.insert(starts, bounds[1:] - bounds[0], len(flat) - 1), np.insert(per_word, bounds[1:] - bounds[0], 1)
        counts = counts + 1
    return spread(flat, starts, per_word), counts


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1, parts: int | None = None) -> list[dict]:
    """Writes docs (doc_id, text) as token files; returns the partitions' bases in order."""
    path, at = path or vocabulary(), local_path(folder)
    os.makedirs(at, exist_ok=True)
    n = parts or partitions(docs.sparkSession)

    def run(batches):
        words = _words(path)
        width = np.dtype("<u2") if max(len(words.is_end), end_id + 1) <= 1 << 16 else np.dtype("<u4")
        task = TaskContext.get()
        stem, mark = f"{at}/part-{task.partitionId():07d}", f".{task.taskAttemptId()}"
        n_docs, n_tokens, n_null = 0, 0, 0
        os.makedirs(at, exist_ok=True)
        with open(f"{stem}.bin{mark}", "wb") as ids_file, open(f"{stem}.idx{mark}", "wb") as index_file:
            for b in blocks(batches, BLOCK_BYTES):
                ids, counts = encode_block(b.column("text"), words, end_id)
                ids_file.write(ids.astype(width).tobytes())
                index = np.empty(len(counts), _ENTRY)
                n_null += b.column("doc_id").null_count  # they come first
                index["doc_id"] = pc.fill_null(b.column("doc_id").cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                index["end"] = n_tokens + np.cumsum(counts)
                index_file.write(index.tobytes())
                n_docs, n_tokens = n_docs + len(counts), n_tokens + len(ids)
        for kind in ("bin", "idx"):
            os.replace(f"{stem}.{kind}{mark}", f"{stem}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (task.partitionId(), n_docs, n_tokens, width.itemsize, n_null)], names=["part", "n_docs", "n_tokens", "width", "n_null"])

    done = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange(n, "doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select("doc_id", "text")
        .mapInArrow(run, "part long, n_docs long, n_tokens long, width long, n_null long")
        .collect()
    )
    bases, docs_before, tokens_before = [], 0, 0
    for r in sorted(done):
        bases.append({"part": r.part, "first_doc": docs_before, "first_token": tokens_before, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "width": r.width, "n_null": r.n_null})
        docs_before, tokens_before = docs_before + r.n_docs, tokens_before + r.n_tokens
    with open(f"{at}/bases.json", "w") as f:
        json.dump(bases, f)
    return bases


def mapped(folder: str, base: dict):
    """A partition's ids and index, memory-mapped."""
    stem = f"{folder}/part-{base['part']:07d}"

    def view(name: str, dtype):
        with open(name, "rb") as f:
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype) if os.fstat(f.fileno()).st_size else np.empty(0, dtype)

    return view(f"{stem}.bin", f"<u{base['width']}"), view(f"{stem}.idx", _ENTRY)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a set, from its files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit little-endian)."""
    at = local_path(folder)
    with open(f"{at}/bases.json") as f:
        bases = [b for b in json.load(f) if b["n_docs"]]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not bases:
        return spark.createDataFrame([], schema)

    def run(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                ids, index = mapped(at, bases[k])
                ends = index["end"].astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                for i in range(0, len(ends), 10_000):
                    s, e = starts[i : i + 10_000], ends[i : i + 10_000]
                    crc = [zlib.crc32(ids[a:z].astype("<u4").tobytes()) for a, z in zip(s, e, strict=True)]
                    unknown = np.arange(i, i + len(e)) < bases[k]["n_null"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(index["doc_id"][i : i + 10_000], mask=unknown), pa.array(s + bases[k]["first_token"]), pa.array(e - s), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spark.range(0, len(bases), 1, len(bases)).mapInArrow(run, schema)


def op6_token_files(spark, sf_dir):
    folder = new_folder(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder)
    return read_documents(spark, folder)

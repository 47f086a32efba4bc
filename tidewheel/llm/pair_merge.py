"""BPE encoding and decoding through a pair occurrence index.

A task cuts a block of texts into pieces (matches of the pre-tokeniser's pattern) and lays its distinct pieces
out as one array of symbols. The index maps each mergeable pair of neighbours to all its positions in that
array. Ranks that have positions are taken in ascending order; one step merges a rank's pair at all its
positions at once and enters the pairs that the new symbol forms with its neighbours. So a step costs
as much as the positions it touches, whatever the pieces' lengths, also for one piece of a megabyte.

Taking a rank at all positions before the next rank gives the library's ids as long as no merge makes a symbol
whose pairs have an earlier rank than the merge itself; the vocabulary is checked for that when it is read.

Pieces are found with array operations on code points. Whether a code point is a letter, a number, white space
or something else is asked of the library's own pre-tokeniser, once for each code point that occurs.

Defined cases: null counts as the empty text, which has no ids; special strings inside texts are one token
each, as in the library's default; null doc_ids stay null; repeated rows give repeated rows; texts of any
length are encoded whole; other columns of the input, whatever their names, are not read (`digests`) or carried
along (`with_ids`); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .prefix_counts import _byte_chars, vocabulary
from .token_files import spread
from .tokens import blocks, plain

BLOCK_BYTES = 12 << 20
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
_EDGE, _GONE = -1, -2


class PairIndex:
    """Positions of mergeable pairs in an array of symbols; pieces are kept apart by edges."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        chars = _byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.byte = np.array([vocab.get(bytes([b]), _EDGE) for b in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary has no token for some byte")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([vocab[raw(a)] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[raw(b)] for _, b in pairs], np.int64)
        self.made = np.array([vocab[raw(a) + raw(b)] for a, b in pairs], np.int64)
        self._check_order()
        keys = self.left * self.size + self.right
        self.rank = np.argsort(keys)
        self.keys = keys[self.rank]
        self.first = np.full((256, 256), len(pairs), np.int64)  # ranks of pairs of bytes
        of_byte = {int(i): b for b, i in enumerate(self.byte)}
        for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True)):
            if a in of_byte and b in of_byte:
                self.first[of_byte[a], of_byte[b]] = r
        texts = [b""] * self.size
        for word, i in [*vocab.items(), *((s.encode(), i) for s, i in self.special.items())]:
            texts[i] = word
        self.bytes_size = np.fromiter(map(len, texts), np.int64, self.size)
        self.bytes_start = np.cumsum(self.bytes_size) - self.bytes_size
        self.bytes_flat = np.frombuffer(b"".join(texts), np.uint8)
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def _check_order(self):
        """A symbol's pairs must come after every merge that makes the symbol."""
        latest = np.full(self.size, -1, np.int64)
        np.maximum.at(latest, self.made, np.arange(len(self.made)))
        if (np.maximum(latest[self.left], latest[self.right]) >= np.arange(len(self.made))).any():
            raise ValueError("the vocabulary merges a pair before a later merge makes one of its parts")

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of ranks where it has none."""
        keys = np.where((a < 0) | (b < 0), -1, a * self.size + b)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], len(self.keys))

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces, bytes one after the other with each piece's size -> ids and each piece's number of ids."""
        ends = np.cumsum(sizes)
        symbols = np.full(len(data) + len(sizes) + 1, _EDGE, np.int64)
        place = np.arange(len(data)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)  # an edge before each piece
        symbols[place] = self.byte[data]
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        none = len(self.keys)
        ranks = self.first[data[:-1], data[1:]]
        ranks[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data))] - 1] = none  # not across pieces
        real = np.flatnonzero(ranks < none)
        index: dict[int, list[np.ndarray]] = {}
        self._enter(index, ranks[real], place[real])
        active = list(index)
        heapify(active)
        while active:
            r = heappop(active)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[symbols[at] == a]
            second = after[at]
            same = symbols[second] == b
            at, second = at[same], second[same]
            if a == b and len(at) > 1:  # in a run of overlapping pairs every other one is merged, from the left
                runs = np.flatnonzero(np.concatenate([[True], second[:-1] != at[1:]]))
                inside = np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))
                at, second = at[inside % 2 == 0], second[inside % 2 == 0]
            if not len(at):
                continue
            symbols[at], symbols[second] = self.made[r], _GONE
            follow = after[second]
            after[at], before[follow] = follow, at
            lead = before[at]
            places = np.concatenate([lead, at])
            new = self.ranks_of(symbols[places], symbols[np.concatenate([at, follow])])
            for some in (slice(0, len(at)), slice(len(at), None)):  # apart: a position may be in both
                found = new[some] < none
                if found.any():
                    for rank in self._enter(index, new[some][found], places[some][found]):
                        heappush(active, rank)
        alive = symbols >= 0
        held = np.concatenate([[0], np.cumsum(alive)])
        edges = np.concatenate([[0], ends]) + np.arange(len(sizes) + 1)
        return symbols[alive], np.diff(held[edges])

    @staticmethod
    def _enter(index: dict, ranks: np.ndarray, places: np.ndarray) -> list[int]:
        """Enters places under their ranks; returns the ranks that were not in the index before."""
        if not len(ranks):
            return []
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]])).tolist()
        fresh = []
        for s, e, r in zip(cuts, [*cuts[1:], len(ranks)], ranks[cuts].tolist(), strict=True):
            if r in index:
                index[r].append(places[s:e])
            else:
                index[r] = [places[s:e]]
                fresh.append(r)
        return fresh

    def _kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        if (kinds == UNKNOWN).any():
            for p in np.unique(points[kinds == UNKNOWN]).tolist():
                one = lambda c, p=p: len(self.splitter.pre_tokenize_str(c + chr(p))) == 1
                self.kind[p] = LETTER if one("a") else NUMBER if one("1") else OTHER if one("#") else SPACE
            kinds = self.kind[points]
        return kinds

    def piece_starts(self, points: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Where pieces start: code points of texts one after the other, with a mark at each text's first."""
        kind = self._kinds(points)
        run = opens.copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        # white space before something else in its text: its last character is a piece or joins what follows
        start[:-1] |= (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~opens[1:]
        joined = np.flatnonzero(run[1:] & (kind[1:] != SPACE) & ~opens[1:] & (points[:-1] == 32)) + 1
        start[joined] = False
        # an apostrophe that starts a piece takes one of the pattern's endings
        quote = np.flatnonzero((points == ord("'")) & start)
        padded, closed = np.append(points, [0, 0, 0]), np.append(opens, [True] * 3)
        one, two = np.where(closed[quote + 1], 0, padded[quote + 1]), np.where(closed[quote + 1] | closed[quote + 2], 0, padded[quote + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[short | long] + 1] = False
        rest = np.concatenate([quote[short] + 2, quote[long] + 3])
        rest = rest[~closed[rest]]
        start[rest[kind[rest] == LETTER]] = True
        return np.flatnonzero(start)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other and each text's number of ids."""
        texts = plain(texts)
        parts_of = None
        if self.special and any(pc.any(pc.match_substring(texts, s), min_count=0).as_py() for s in self.special):
            split = [[p for p in self.special_pattern.split(t) if p] for t in texts.to_pylist()]
            parts_of = np.concatenate([[0], np.cumsum([len(p) for p in split])])
            texts = pa.array([p for parts in split for p in parts], pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        total = int(bounds[-1])
        if not total:
            return np.zeros(0, np.int64), np.zeros(len(texts) if parts_of is None else len(parts_of) - 1, np.int64)
        data = texts.buffers()[2]
        points = np.frombuffer(data.to_pybytes()[:total].decode().encode("utf-32-le"), np.uint32)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.cumsum(width) - width
        opens = np.zeros(len(points), bool)
        firsts = np.searchsorted(place, bounds[:-1][np.diff(bounds) > 0])
        opens[firsts] = True
        starts = self.piece_starts(points, opens)
        if parts_of is not None:  # a special string is one piece
            inside = np.zeros(len(points) + 1, np.int64)
            spec = np.flatnonzero(pc.is_in(texts, pa.array(list(self.special), pa.large_string())).to_numpy(zero_copy_only=False))
            np.add.at(inside, np.searchsorted(place, bounds[spec]) + 1, 1)
            np.add.at(inside, np.searchsorted(place, bounds[spec + 1]), -1)
            starts = starts[np.cumsum(inside)[starts] == 0]
        cuts = np.append(place[starts], total)
        del points, width, place, opens
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data).dictionary_encode()
        which = pieces.indices.to_numpy(zero_copy_only=False)
        flat, starts, sizes = self._distinct(pieces.dictionary)
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        held = ends[np.searchsorted(cuts, bounds)]
        if parts_of is not None:
            held = held[parts_of]
        return spread(flat, starts[which], sizes[which]), np.diff(held)

    def _distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pieces -> flat ids, each one's start and number."""
        bounds = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        ids, sizes = self.merge(data, np.diff(bounds))
        starts = np.cumsum(sizes) - sizes
        for word, i in self.special.items():
            k = pc.index(pieces, pa.scalar(word, pa.large_string())).as_py()
            if k >= 0:
                starts[k], sizes[k] = len(ids), 1
                ids = np.append(ids, i)
        return ids, starts, sizes

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """Raw bytes of all ids and the end of each text's bytes in them."""
        sizes = self.bytes_size[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        return memoryview(spread(self.bytes_flat, self.bytes_start[ids], sizes)), ends


@lru_cache(maxsize=2)
def pair_index(path: str) -> PairIndex:
    return PairIndex(path)


def with_ids(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """docs with `out`, the token ids (array<int>) of `text`."""
    path = path or vocabulary()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        flat, counts = pair_index(path).encode(texts)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32()))

    return docs.withColumn(out, ids(F.col(text)))


def with_text(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with `out`, the text that `ids` stand for, special tokens included; bytes that are no UTF-8 become U+FFFD, null ids give an empty text."""
    path = path or vocabulary()

    @F.arrow_udf(T.StringType())
    def decoded(rows: pa.Array) -> pa.Array:
        lists = rows.to_pylist()
        counts = np.fromiter((len(r or ()) for r in lists), np.int64, len(lists))
        flat = np.fromiter((i for r in lists for i in r or ()), np.int64, int(counts.sum()))
        data, ends = pair_index(path).decode(flat, counts)
        return pa.array([bytes(data[s:e]).decode(errors="replace") for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.string())

    return docs.withColumn(out, decoded(F.col(ids)))


def digests(docs: DataFrame, path: str | None = None, block: int = BLOCK_BYTES) -> DataFrame:
    """Per document its ids' number and hash and the decoded text's hash; no shuffle, a block of texts in memory at a time."""
    path = path or vocabulary()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        index = pair_index(path)
        for b in blocks(batches, block):
            ids, counts = index.encode(b.column("text"))
            data, ends = index.decode(ids, counts)
            words, stops = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(counts) * 4
            a = [hashlib.sha256(words[s:e]).hexdigest() for s, e in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]
            z = [hashlib.sha256(bytes(data[s:e]).decode(errors="replace").encode()).hexdigest() for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op12_pair_merge(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Words of whole blocks of texts as numpy arrays, for operators that work on n-grams inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 8 << 20
BLOCK_ROWS = 1 << 16


@dataclass
class Block:
    """Words of consecutive texts.

    which: per word, its index in `hashes`; hashes: 64-bit hash of each distinct word;
    starts: per text, its first word in `which`, and one more entry, the end."""

    rows: pa.RecordBatch
    which: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def plain(texts: pa.Array) -> pa.Array:
    """texts as large strings without nulls, in buffers of their own.

    The copy matters: in pyarrow 23 string kernels misread a slice that was cast to large strings."""
    whole = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(whole.cast(pa.large_string()), "")


def split_block(rows: pa.RecordBatch, text: str = "text") -> Block:
    """Lower-cases A-Z and splits at space and tab to carriage return; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(plain(rows.column(text))))
    starts = lists.offsets.to_numpy().astype(np.int64)
    flat = pc.list_flatten(lists)
    real = pc.not_equal(pc.binary_length(flat), 0)
    if not pc.all(real, min_count=0).as_py():  # leading and trailing white space gives empty strings
        keep = real.to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(keep)])
        starts, flat = before[starts - starts[0]], flat.filter(real)
    else:
        starts = starts - starts[0]
    coded = flat.dictionary_encode()
    return Block(rows, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), word_hashes(coded.dictionary.to_pylist()), starts)


def blocks(batches, size: int = BLOCK_BYTES, text: str = "text"):
    """Record batches regrouped into blocks of about `size` bytes of text and BLOCK_ROWS rows at most."""
    held, held_bytes, held_rows = [], 0, 0

    def whole():
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(n), 0
        while at < len(n):
            used = ends[at - 1] if at else 0
            k = int(np.searchsorted(ends, used + size - held_bytes, "right"))
            k = min(max(k, at + (not held)), at + BLOCK_ROWS - held_rows, len(n))
            if k > at:
                held.append(b.slice(at, k - at))
                held_bytes, held_rows, at = held_bytes + int(ends[k - 1] - used), held_rows + k - at, k
            if at < len(n) or held_rows >= BLOCK_ROWS or held_bytes >= size:
                yield whole()
                held, held_bytes, held_rows = [], 0, 0
    if held:
        yield whole()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def record_group(part: int, block: int, groups: int) -> int:
    """The group of a block's record: a hash of the task's partition and the block's number in it, so that all tasks' first blocks spread."""
    return int(mix(mix(np.array([part], np.uint64) + np.uint64(1)) + np.uint64(block))[0] % np.uint64(groups))


def run_starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = False
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)

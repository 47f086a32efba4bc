"""Exact token counts at every prefix of a text, by prefix dynamic programming.

For byte-pair encoding the encoding of a prefix is the encoding of a shorter prefix plus one token: the
token t that ends at byte i is the one whose left neighbour, the last token of the prefix before t,
stays apart from t when the two are merged anew. Storing the last token and the count for each prefix
of a piece therefore gives the exact count at each of its bytes in one pass, without encoding any
prefix. Pieces (matches of the pre-tokeniser's pattern) are independent, so the count at a prefix of a
text is the count at the start of its piece plus the count inside the piece. A piece that is a token is
one, the counts of others are remembered up to a bound; tables inside pieces are made for the pieces asked for. A piece that is no token costs its bytes times the vocabulary's longest token in look-ups, also a single
piece of a megabyte.

Defined cases: null and empty texts have no tokens and one prefix, of 0 bytes; special strings inside
texts are one token each, as in the library's default; repeated rows give repeated rows, null doc_ids stay null;
texts of any length are counted whole; other columns of the input, whatever their names, are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The ByteLevel pre-tokeniser's own pattern (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """The merges of a vocabulary file, and counts at every prefix of pieces and texts."""

    #: Longer pieces are not remembered, so what is remembered has a bound in bytes as well.
    KEPT_BYTES = 64

    def __init__(self, path: str, remember: int = 500_000):
        spec = json.load(open(path, encoding="utf-8"))
        chars = _byte_chars()
        raw = lambda s: bytes(chars[c] for c in s)
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        self.tokens = {raw(s): i for s, i in vocab.items() if s not in special}
        self.longest = max(map(len, self.tokens))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank, self.parts = {}, {}
        for r, (a, b) in enumerate(pairs):
            x, y = self.tokens[raw(a)], self.tokens[raw(b)]
            whole = self.tokens[raw(a) + raw(b)]
            self.rank[x, y] = (r, whole)
            self.parts.setdefault(whole, (x, y, r))
        self.pattern = regex.compile(BYTE_LEVEL)
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.special_strings = special
        #: At most `remember` entries each: pieces with their counts, and neighbours that were asked for. Reachable
        #: tokens are as many as the vocabulary at most.
        self.remember = remember
        self.known: dict[str, int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.reachable: dict[int, bool] = {}

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether left and right, next to each other, survive as two tokens when their bytes are merged anew.

        Undoes merges from the newer of the two tokens on: the pair is broken as soon as a merge across
        the boundary would have come before the merge that made the token on either side."""
        key = (left, right)
        if (known := self.apart.get(key)) is not None:
            return known
        limit, a, b, out = len(self.rank), left, right, True
        while True:
            cross = self.rank.get((a, b))
            if cross is not None and cross[0] < limit:
                out = False
                break
            pa_, pb = self.parts.get(a), self.parts.get(b)
            if pa_ is None and pb is None:
                break
            # the later merge is undone first; of equal ranks the left one came first, so the right is undone
            if pb is None or (pa_ is not None and pa_[2] > pb[2]):
                limit, a = pa_[2], pa_[1]
                # a merge across of the same rank would start further right and so come later
            else:
                limit, b = pb[2] + 1, pb[0]
                # a merge across of the same rank starts further left and so comes first
        if len(self.apart) >= self.remember:
            self.apart.clear()
        self.apart[key] = out
        return out

    def _solve(self, data: bytes) -> list[int]:
        """Token counts at the prefixes of 0..len(data) bytes of one piece."""
        n = len(data)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        get, longest, apart, known = self.tokens.get, self.longest, self.stays_apart, self.apart.get
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = get(data[j:i])
                if t is None:
                    continue
                if j == 0:
                    ok = self.whole(t, data[:i])
                elif (ok := known((last[j], t))) is None:
                    ok = apart(last[j], t)
                if ok:
                    last[i], count[i] = t, count[j] + 1
                    break
            if last[i] < 0:
                raise ValueError(f"no encoding of {data[:i]!r}")
        return count

    def piece(self, data: bytes) -> np.ndarray:
        """Token counts at the prefixes of 1..len(data) bytes of one piece."""
        return np.array(self._solve(data)[1:], np.int32)

    def whole(self, token: int, data: bytes) -> bool:
        """Whether merging the token's bytes (data) ends in this one token (a vocabulary can have unreachable entries)."""
        out = self.reachable.get(token)
        if out is None:
            out = self.reachable[token] = self._merges_to(token, data)
        return out

    def _merges_to(self, token: int, data: bytes) -> bool:
        ids = [self.tokens[data[k : k + 1]] for k in range(len(data))]
        while len(ids) > 1:
            found = [(m[0], k, m[1]) for k in range(len(ids) - 1) if (m := self.rank.get((ids[k], ids[k + 1])))]
            if not found:
                return False
            _, k, merged = min(found)
            ids[k : k + 2] = [merged]
        return ids == [token]

    def count(self, piece: str) -> int:
        """Tokens of a whole piece: one if it is a token itself, else what the prefix table ends with."""
        data = piece.encode()
        t = self.tokens.get(data)
        n = 1 if piece in self.special_strings or (t is not None and self.whole(t, data)) else self._solve(data)[-1]
        if len(data) <= self.KEPT_BYTES:
            if len(self.known) >= self.remember:
                self.known.clear()
            self.known[piece] = n
        return n

    def counts(self, parts: list[str]) -> list[int]:
        got = list(map(self.known.get, parts))
        if None in got:
            got = [self.count(p) if c is None else c for p, c in zip(parts, got, strict=True)]
        return got

    def solved(self, piece: str) -> np.ndarray:
        return self.piece(piece.encode())

    def parts_of(self, text: str) -> list[str]:
        """The text's pieces in order; special strings are pieces of their own."""
        if self.special is None or not any(s in text for s in self.special_strings):
            return self.pattern.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.pattern.findall(part)
        return out

    def solve_part(self, piece: str) -> np.ndarray:
        return self.solve_special(piece) if piece in self.special_strings else self.solved(piece)

    @lru_cache(maxsize=64)  # noqa: B019
    def solve_special(self, piece: str) -> np.ndarray:
        """One token at its end; a prefix that ends inside the string is ordinary text."""
        inner = np.concatenate([np.zeros(0, np.int32), *self._chain(self.pattern.findall(piece))])
        inner[-1] = 1
        return inner

    def _chain(self, pieces):
        at = 0
        for p in pieces:
            c = self.solved(p)
            yield c + at
            at += int(c[-1])

    def ends(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Byte offsets and token counts at the ends of the pieces: the sparse form of the prefix table."""
        parts = self.parts_of(text or "")
        return np.cumsum([len(p.encode()) for p in parts], dtype=np.int64), np.cumsum(self.counts(parts), dtype=np.int64)

    def budget(self, text: str | None, limit: int) -> tuple[int, int, int]:
        """Bytes, tokens, and the bytes of the longest prefix of at most limit tokens that ends between characters.

        The piece in which the limit is reached is answered from its own prefix table."""
        parts = self.parts_of(text or "")
        counts = self.counts(parts)
        total, size = sum(counts), len((text or "").encode())
        if total <= limit:
            return size, total, size
        at, k = 0, 0
        while at + counts[k] <= limit:
            at, k = at + counts[k], k + 1
        inner = self.solve_part(parts[k]).tolist()
        data = parts[k].encode()
        fits = next((i for i in range(len(data) - 1, 0, -1) if inner[i - 1] <= limit - at and data[i] & 0xC0 != 0x80), 0)
        return size, total, sum(len(p.encode()) for p in parts[:k]) + fits

    def table(self, text: str | None) -> np.ndarray:
        """Token counts at all prefixes, of 0 to all bytes."""
        return np.concatenate([np.zeros(1, np.int32), *self._whole_chain(self.parts_of(text or ""))])

    def _whole_chain(self, parts):
        at = 0
        for p in parts:
            c = self.solve_part(p)
            yield c + at
            at += int(c[-1])

    def longest_within(self, text: str, budget: int) -> int:
        """Bytes of the longest prefix with at most budget tokens that ends between characters."""
        counts = self.table(text)
        data = text.encode()
        ok = np.flatnonzero(counts <= budget)
        for i in ok[::-1]:
            if i == len(data) or data[i] & 0xC0 != 0x80:
                return int(i)
        return 0


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_tables(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, piece_ends and piece_counts (array<long>).

    The arrays are the prefix table at the ends of pieces; the counts inside a piece come from
    `PrefixCounter.piece`, so any truncation or budget question is a search in them."""
    path = path or vocabulary()

    def run(batches):
        c = counter(path)
        for b in batches:
            rows = [c.ends(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id").cast(pa.int64()),
                    pa.array([int(e[-1]) if len(e) else 0 for e, _ in rows], pa.int64()),
                    pa.array([int(n[-1]) if len(n) else 0 for _, n in rows], pa.int64()),
                    pa.array([e for e, _ in rows], pa.list_(pa.int64())),
                    pa.array([n for _, n in rows], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "piece_ends", "piece_counts"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, piece_ends array<long>, piece_counts array<long>")


def budget_report(docs: DataFrame, limit: int = 512, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit, cut_bytes.

    cut_bytes is the longest prefix of at most limit tokens that ends between characters, from the prefix table."""
    path = path or vocabulary()

    def run(batches):
        c = counter(path)
        for b in batches:
            found = [c.budget(t.as_py(), limit) for t in b.column("text")]
            size, n, cut = (pa.array([f[k] for f in found], pa.int64()) for k in range(3))
            over = pa.array([f[1] > limit for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), size, n, over, cut], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long")


def op9_token_counts(spark, sf_dir):
    return budget_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))

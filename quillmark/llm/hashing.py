"""Vectorised hashes of words and of runs of words, over whole Arrow columns of text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BASE = U(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, U)
HASH_BYTES = 1 << 18  # of texts whose words are hashed at once


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


BYTES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
BYTES_FOLDED = BYTES[FOLD]


def powers(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([_powers, _powers * (_powers[-1] * BASE)])
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more for the end); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """Words (runs of bytes other than space and \\x09-\\x0D) of some texts: where they are and their hashes.

    first[i]:first[i + 1] are the words of text i.
    """

    def __init__(self, column: pa.Array, fold: bool):
        raw, at = text_bytes(column)
        inside = ~SPACE[raw]
        before = np.empty(len(raw), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < len(raw)]] = False  # a text begins: no word goes on
        self.raw, self.at = raw, at
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(len(raw), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = at[1:][at[1:] > 0] - 1
        after[ends] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)
        size = (self.end - self.start).astype(U)
        self.hash = np.empty(len(size), U)
        if len(size):  # some bytes at a time: what is held for each byte takes eight and more
            edge = np.append(self.start, len(raw))
            cuts = np.append(np.searchsorted(self.start, np.arange(self.start[0], len(raw), HASH_BYTES)), len(size))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a < b:
                    lo, hi = edge[a], edge[b]
                    rel = np.arange(lo, hi) - np.repeat(edge[a:b], np.diff(edge[a : b + 1]))
                    with np.errstate(over="ignore"):
                        value = (BYTES_FOLDED if fold else BYTES)[raw[lo:hi]]
                        value *= powers(int(rel.max()) + 1)[rel]
                        value *= inside[lo:hi]
                        self.hash[a:b] = mix(np.add.reduceat(value, edge[a:b] - lo) + size[a:b] * U(0xA24BAED4963EE407))

    def __len__(self) -> int:
        return len(self.start)

    def runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The position of the first word and the hash of every run of k words inside one text."""
        n = len(self) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        with np.errstate(over="ignore"):
            h = np.full(n, U(k) * U(0x2545F4914F6CDD1D))
            for j in range(k):
                h = (h ^ self.hash[j : j + n]) * U(0x9FB21C651E98DF25)
                h ^= h >> U(29)
        last = np.repeat(self.first[1:], np.diff(self.first))  # where the text of each word ends
        ok = np.flatnonzero(np.arange(n) + k <= last[:n])
        return ok, mix(h[ok])

    def owner(self, position: np.ndarray) -> np.ndarray:
        """The text of each word position."""
        return np.searchsorted(self.first, position, "right") - 1


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), sorted, of the distinct shingles of k words; a text of fewer words is one shingle, an empty one none."""
    at, h = words.runs(k)
    text = words.owner(at)
    few = np.flatnonzero((np.diff(words.first) > 0) & (np.diff(words.first) < k))
    if len(few):
        short = []
        with np.errstate(over="ignore"):
            for i in few:
                x = U(int(words.first[i + 1] - words.first[i])) * U(0x2545F4914F6CDD1D)
                for w in words.hash[words.first[i] : words.first[i + 1]]:
                    x = (x ^ w) * U(0x9FB21C651E98DF25)
                    x ^= x >> U(29)
                short.append(x)
        text, h = np.concatenate([text, few]), np.concatenate([h, mix(np.array(short, U))])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[keep], h[keep]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """A bucket from 0 to n - 1 that does not fall as the hash rises, so that sorted hashes lie bucket by bucket."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)


def runs_of(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of each bucket that occurs in a sorted array."""
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[begin].tolist(), begin.tolist(), np.append(begin[1:], len(bucket)).tolist(), strict=True)) if len(begin) else []


def slices(raw_at: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut texts into consecutive groups of about ``most`` bytes; a longer text is a group of its own."""
    out, i, n = [], 0, len(raw_at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(raw_at, raw_at[i] + most, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

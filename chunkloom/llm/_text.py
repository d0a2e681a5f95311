"""Vectorised text kernel: whole Arrow batches become code-point arrays, words and hashes.

Documents of a chunk are joined with NUL, so that no word or n-gram spans two of them. All the
functions see whole texts; a chunk is closed after a document, never inside one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_CHARS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def fold_table() -> np.ndarray:
    """Code point -> lower-case code point for letters and digits, 0 for everything else."""
    import unicodedata

    table = np.zeros(0x110000, np.uint32)
    for c in range(0x30000):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    table[0x30000:0x323B0] = np.arange(0x30000, 0x323B0)
    del unicodedata
    return table


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in batch.column(column).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts hold about CHUNK_CHARS characters together."""
    for batch in batches:
        texts, at, size = texts_of(batch, column), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK_CHARS or i + 1 == len(texts):
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, size = i + 1, 0


def load(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of NUL-terminated texts, and the position at which each text starts (n + 1)."""
    joined = "\0".join(texts) + "\0" if texts else ""
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=offs[1:])
    return cps, offs


@cache
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(size, _BASE), np.full(size, _INVERSE)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(1 << max(21, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place on a fresh array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words (maximal runs of letters and digits) of a chunk of texts.

    ``folded``: lower-case code points, 0 at separators; ``start``/``end``: of each word in the
    chunk; ``first``: number of each text's first word, n + 1 values; ``offs`` as from load().
    """

    def __init__(self, texts: list[str]) -> None:
        self.cps, self.offs = load(texts)
        self.folded = fold_table()[self.cps]
        w = self.folded != 0
        edge = np.flatnonzero(np.diff(w.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offs)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        p, q = powers(len(self.folded))
        c = np.zeros(len(self.folded) + 1, np.uint64)
        np.cumsum(self.folded * p[: len(self.folded)], out=c[1:])
        return mix((c[self.end] - c[self.start]) * q[self.start])


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each text, and each text's first (n + 1).

    A text of one to k - 1 words has one shingle of all its words; one without words has none.
    """
    h, first = words.hashes(), words.first
    n = np.diff(first)
    if not len(h):
        return h, np.zeros(len(first), np.int64)
    out = np.zeros(len(h), np.uint64)
    last = np.repeat(first[1:], n)  # end of the text of each word
    at = np.arange(len(h))
    for j in range(k):
        seed = np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = np.zeros(len(h), np.uint64)
        x[: len(h) - j or None] = h[j:]
        x[at + j >= last] = 0
        out += x * seed
    keep = (at + k <= last) | (at == np.repeat(first[:-1], n)) & (np.repeat(n, n) < k)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    return mix(out[keep]), np.concatenate([[0], np.cumsum(count)])


def segments(values: np.ndarray, first: np.ndarray, ufunc: np.ufunc, empty: float = 0) -> np.ndarray:
    """ufunc.reduceat over consecutive segments, right also for empty ones."""
    n = np.diff(first)
    shape = (len(n), *values.shape[1:])
    out = np.full(shape, empty, values.dtype)
    full = n > 0
    if full.any():
        out[full] = ufunc.reduceat(values, first[:-1][full], axis=0)
    return out


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())

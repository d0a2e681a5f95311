"""Character n-grams of the distinct words of a chunk, hashed into buckets without a loop over words."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._text import Words, mix, powers


class Grams:
    """``inverse``: number of each word's form among the distinct ones; ``buckets``: of the n-grams of all
    forms, one form after another; ``first``: each form's first n-gram (forms + 1 values).

    A form is padded with one boundary sign on either side; with ``whole`` it also counts as one n-gram.
    """

    def __init__(self, words: Words, sizes: tuple[int, ...], bits: int, whole: bool = False) -> None:
        h = words.hashes()
        _, at, self.inverse = np.unique(h, return_index=True, return_inverse=True)
        start, end = words.start[at], words.end[at] + 2  # in the array padded with one sign in front
        g = np.ones(len(words.folded) + 1, np.uint64)
        np.maximum(words.folded, 1, out=g[1:], casting="unsafe")
        p, q = powers(len(g) + 1)
        c = np.zeros(len(g) + 1, np.uint64)
        np.cumsum(g * p[: len(g)], out=c[1:])
        length = end - start
        counts = [np.maximum(length - n + 1, 0) for n in sizes] + [np.ones_like(length)] * whole
        total = np.sum(counts, axis=0) if len(at) else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
        self.buckets = np.zeros(self.first[-1], np.uint32)
        place = self.first[:-1].copy()
        for k, count in enumerate(counts):
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            a = np.repeat(start, count) + inner
            b = a + sizes[k] if k < len(sizes) else np.repeat(end, count)
            x = mix((c[b] - c[a]) * q[a] + np.uint64(min(k, len(sizes)) + 1))
            self.buckets[np.repeat(place, count) + inner] = (x >> np.uint64(64 - bits)).astype(np.uint32)
            place += count


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 0) -> DataFrame:
    """The ``rows`` rows of ``df`` whose key's hash is smallest, or all of them; no key may make it more."""
    n = df.count()
    if n <= rows:
        return df
    h = F.xxhash64(F.col(key), F.lit(seed))
    enough = rows + 10 * rows**0.5 + 100  # hashes below this limit are expected; what is too much is cut
    return df.where(h < F.lit(int(min((1 << 63) - 1, -(1 << 63) + (enough / n) * (1 << 64))))).orderBy(h, key).limit(rows)

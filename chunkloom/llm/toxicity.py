"""Operator 10: toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams, a window the mean of its words, in which a
repeated word counts once and its further places as zeros, so that repetition adds nothing; a linear softmax
reads the window. Vectors and softmax are trained together in numpy on windows of labelled
documents (bounded sample of SAMPLE rows, half of it held out to set the threshold). Labels name documents,
not places, so after the first epochs the windows of toxic documents that look clean are relabelled.
Misspellings and inflections that were never seen share most of their n-grams with those that were.

Being linear, the trained model folds into one number per n-gram bucket; scoring is one scan with this
table of 2 ** BITS floats, every window of every whole text counts, and the worst one decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._frames import slices
from chunkloom.llm._grams import Grams, bounded_sample
from chunkloom.llm._text import Words, segments
from chunkloom.plans.lineage import BROADCAST_ROWS, small_side

SAMPLE = 6000  #: labelled rows at most that the model is fitted on
SIZES, BITS, DIM, WINDOW = (3, 4, 5), 18, 8, 16
CLEAN = 4  #: clean documents per toxic one, and clean windows per window of toxic ones, at most
EPOCHS, STEPS, BATCH, RATE = 10, 400, 256, 0.4  #: STEPS: minibatches at least, for small samples


class Model:
    """``table``: of each bucket its share of the logit; ``bias``; ``threshold`` on a document's worst logit."""

    def __init__(self, table: np.ndarray, bias: float, threshold: float) -> None:
        self.table, self.bias, self.threshold = table.astype(np.float32), float(bias), float(threshold)


def previous(forms: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each word the last word before it in its text that has the same form, -1 if there is none."""
    order = np.argsort(forms, kind="stable")
    out = np.full(len(forms), -1, np.int64)
    same = forms[order][1:] == forms[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    out[out < np.repeat(first[:-1], np.diff(first))] = -1
    return out


def window_means(values: np.ndarray, before: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The mean over each window, which has ``size`` <= WINDOW words from ``start`` on; a word that stood in it before counts as 0."""
    total = np.zeros(len(start))
    for j in range(int(size.max(initial=0))):
        at = np.minimum(start + j, len(values) - 1)
        new = (j < size) & (before[at] < start)
        total += np.where(new, values[at], 0)
    return total / np.maximum(size, 1)


def worst_windows(words: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the highest mean of a window of WINDOW words (of all the words of a shorter text), and where it starts."""
    n, first = np.diff(words.first), words.first
    best, where = np.full(len(n), -np.inf), np.zeros(len(n), np.int64)
    if not n.any():
        return best, where
    g = Grams(words, SIZES, BITS, whole=True)
    mean = segments(table[g.buckets].astype(np.float64), g.first, np.add) / np.maximum(np.diff(g.first), 1)
    count = np.where(n > 0, np.maximum(n - WINDOW + 1, 1), 0)  # windows of each text
    lead = np.concatenate([[0], np.cumsum(count)])
    inner = np.arange(lead[-1]) - np.repeat(lead[:-1], count)
    means = window_means(mean[g.inverse], previous(g.inverse, first), np.repeat(first[:-1], count) + inner, np.repeat(np.minimum(n, WINDOW), count))
    full = n > 0
    best[full] = np.maximum.reduceat(means, lead[:-1][full])
    at = np.flatnonzero(means >= np.repeat(best, count) - 1e-9)  # of equal windows the first
    text = np.searchsorted(lead, at, "right") - 1
    text, head = np.unique(text, return_index=True)
    where[text] = inner[at[head]]
    return best, where


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Fits on a random half of the rows, sets the threshold on the other; of one class only, nothing is toxic."""
    labels = np.asarray(labels, np.int64)
    rng = np.random.default_rng(seed)
    even = rng.permutation(len(texts)) % 2 == 0  # drawn, so that no pattern of the ids decides the halves
    fit = np.array([i for i in np.flatnonzero(even) if texts[i]], np.int64)
    clean = rng.permutation(fit[labels[fit] == 0])[: CLEAN * int((labels[fit] == 1).sum())]
    fit = np.sort(np.concatenate([fit[labels[fit] == 1], clean]))
    table, bias = _fit(_Bag([texts[i] for i in fit]), labels[fit], rng)
    if table is None:
        return Model(np.zeros(1 << BITS), 0.0, np.inf)
    odd = [i for i in np.flatnonzero(~even) if texts[i]]
    held, best = labels[odd], np.zeros(len(odd))
    for at in range(0, len(odd), 200):
        w = Words([texts[i] for i in odd[at : at + 200]])
        best[at : at + 200] = worst_windows(w, table)[0] + bias
    return Model(table, bias, threshold_of(best, held))


def threshold_of(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the widest-F0.5 gap: precision weighs double."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    if not y.sum():
        return np.inf
    hit, n = np.cumsum(y), np.arange(1, len(y) + 1)
    f = 1.25 * hit / (n + 0.25 * y.sum())
    last = np.append(s[1:] < s[:-1], True)
    k = int(np.argmax(np.where(last, f, -1)))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1e-9)


class _Bag:
    """Words and n-grams of many texts, gathered in slices so that memory follows the n-grams alone."""

    def __init__(self, texts: list[str]) -> None:
        first, inverse, grams, buckets = [np.zeros(1, np.int64)], [], [np.zeros(1, np.int64)], []
        for at in range(0, len(texts), 200):
            words = Words(texts[at : at + 200])
            g = Grams(words, SIZES, BITS, whole=True)
            inverse.append((g.inverse + sum(len(x) - 1 for x in grams[1:])).astype(np.int32))
            first.append(words.first[1:] + first[-1][-1])
            buckets.append(g.buckets)
            grams.append(np.concatenate([[0], g.first[1:] + grams[-1][-1]]))
        self.first = np.concatenate(first)
        self.grams = np.concatenate([[0], *[x[1:] for x in grams[1:]]])
        self.inverse = np.concatenate([np.zeros(0, np.int32), *inverse])
        self.buckets = np.concatenate([np.zeros(0, np.uint32), *buckets])

    def means(self, table: np.ndarray) -> np.ndarray:
        """Of each word the mean of its n-grams' values."""
        c = np.concatenate([[0.0], np.cumsum(table[self.buckets], dtype=np.float64)])
        return ((c[self.grams[1:]] - c[self.grams[:-1]]) / np.maximum(np.diff(self.grams), 1))[self.inverse]


def _fit(words: _Bag, y_doc: np.ndarray, rng: np.random.Generator):
    n = np.diff(words.first)
    doc = np.repeat(np.arange(len(n)), np.maximum(-(-n // WINDOW), 1) * (n > 0))
    if not len(doc) or y_doc.min(initial=1) == y_doc.max(initial=0):
        return None, 0.0
    inner = np.arange(len(doc)) - np.searchsorted(doc, doc)
    start = words.first[doc] + inner * WINDOW
    end = np.minimum(start + WINDOW, words.first[doc + 1])
    start = np.maximum(end - WINDOW, words.first[doc])
    y = y_doc[doc]
    before = previous(words.inverse, words.first)
    bad, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    clean = rng.permutation(clean)[: CLEAN * len(bad)]
    e = rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32)
    w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    acc_e, acc_w = np.full(1 << BITS, 1e-3, np.float32), np.full((DIM, 2), 1e-3, np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // max(1, len(bad) + len(clean))))
    for epoch in range(epochs):
        if epoch >= epochs // 2:  # relabel: a window of a toxic document must itself look toxic
            v = e @ (w[:, 1] - w[:, 0])
            logit = window_means(words.means(v), before, start, end - start) + b[1] - b[0]
            top = np.full(len(n), -np.inf)
            np.maximum.at(top, doc, logit)
            y = ((y_doc[doc] == 1) & ((logit > 0) | (logit == top[doc]))).astype(np.int64)
        rows = rng.permutation(np.concatenate([bad, clean]))
        for at in range(0, len(rows), BATCH):
            k = rows[at : at + BATCH]
            m = end[k] - start[k]
            owner = np.repeat(np.arange(len(k)), m)
            at_word = np.repeat(start[k], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            new = before[at_word] < np.repeat(start[k], m)
            owner, word = owner[new], words.inverse[at_word[new]]
            size = words.grams[word + 1] - words.grams[word]
            gram = words.buckets[np.repeat(words.grams[word], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            share = np.repeat((1.0 / (m[owner] * size)).astype(np.float32), size)
            bag = np.repeat(owner, size)
            h = np.stack([np.bincount(bag, share * e[gram, d], len(k)) for d in range(DIM)], 1).astype(np.float32)
            z = h @ w + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(k)), y[k]] -= 1
            dh = (p @ w.T) * RATE
            dw = h.T @ p / len(k)
            acc_w += dw**2
            w -= 0.1 * dw / np.sqrt(acc_w)
            b -= 0.1 * p.mean(0)
            used, pos = np.unique(gram, return_inverse=True)
            grad = np.stack([np.bincount(pos, share * dh[bag, d], len(used)) for d in range(DIM)], 1).astype(np.float32)
            acc_e[used] += (grad**2).mean(1)
            e[used] -= RATE * grad / np.sqrt(acc_e[used])[:, None]
    v = e @ (w[:, 1] - w[:, 0])
    seen = np.zeros(1 << BITS, bool)
    seen[words.buckets] = True
    v[~seen] = v[seen].mean()  # a bucket that no training word has says nothing
    return v, float(b[1] - b[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on the driver from at most about ``sample`` labelled rows; rows without id, text or label don't count."""
    named = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_id is not null and _y in (0, 1)").distinct()
    rows = bounded_sample(named, "_id", sample)
    n = rows.count()
    d = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string").alias("_t")).where("_t is not null")
    # one text a row of the sample, however often its id occurs
    got = d.join(small_side(rows, n, BROADCAST_ROWS), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t")).toPandas().sort_values(["_id", "_y"], kind="stable")
    return train(got["_t"].tolist(), got["_y"].to_numpy())


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, score, worst_word, is_toxic)``, a row for each row of ``docs``.

    ``score`` is the softmax's probability for the worst window, ``worst_word`` the number of its first
    word (of the first such window in a tie). Texts without words (null, empty, signs only) score 0 and are
    not toxic. Texts of any length are scored in every window. Repeated rows are scored alike; a null doc_id is
    kept; an empty table gives no rows; other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for part, texts in slices(batches):
            words = Words([t or "" for t in texts])
            best, where = worst_windows(words, m.table)
            logit = best + m.bias
            score = np.round(1 / (1 + np.exp(-np.clip(logit, -50, 50))), 6)
            score[np.diff(words.first) == 0] = 0
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(where), pa.array(logit > m.threshold)], ["doc_id", "score", "worst_word", "is_toxic"])

    return d.mapInArrow(run, "doc_id bigint, score double, worst_word bigint, is_toxic boolean")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

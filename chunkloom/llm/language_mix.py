"""Operator 3: language mixtures of documents by expectation-maximisation over n-gram likelihoods.

A document's words count where they have a letter. Per language, smoothed frequencies of boundary-padded character trigrams come from labelled documents
(bounded sample of SAMPLE rows a language); a further component ``und`` gives every trigram the same small
probability. A document is a bag of words drawn from a mixture of languages; EM estimates the proportions.
The language set is chosen by penalised likelihood: starting from all languages, each in turn, the one of the
smallest share first, is taken out if that raises log-likelihood - PENALTY * |set| * log(words). EM runs until
a bound on what is left to gain falls below GAIN, or for ROUNDS rounds; a smaller set begins from the
proportions of the larger one.

One scan: EM runs for all the documents of an Arrow slice at once, over a words x languages matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chunkloom.llm._frames import slices
from chunkloom.llm._grams import Grams
from chunkloom.llm._text import Words, segments

SAMPLE = 1500  #: labelled documents a language at most, about
BITS, SIZES = 16, (3,)
TEMPER = 0.5  #: overlapping trigrams aren't independent
SMOOTHING, UNKNOWN = 0.02, 2e-6  #: added to each trigram's count; probability of a trigram in ``und``
ROUNDS, GAIN, PENALTY = 64, 0.5, 1.0
REJECT = 0.5  #: share of ``und`` above which a document is in no known language
UND = "und"


class Languages:
    """``names``, sorted; ``table``: (buckets, languages) tempered log probabilities."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        total = counts.sum(1, keepdims=True)
        self.table = (TEMPER * np.log((counts + SMOOTHING) / (total + SMOOTHING * (1 << BITS)))).T.astype(np.float32)


def trigram_counts(texts: list[str]) -> np.ndarray:
    words = Words(texts)
    g = Grams(words, SIZES, BITS)
    times = np.bincount(g.inverse, minlength=len(g.first) - 1)
    return np.bincount(g.buckets, np.repeat(times, np.diff(g.first)), 1 << BITS)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Languages:
    """The languages of column ``lang`` in order of their names; rows without text or language don't count."""
    d = docs.select(F.col("lang").cast("string").alias("l"), F.col("text").cast("string").alias("t"), F.xxhash64("doc_id").alias("h"))
    sizes = {r[0]: r[1] for r in d.where("l is not null").groupBy("l").count().collect()}
    if not sizes:
        return Languages([], np.zeros((0, 1 << BITS)))
    limit = {l: int(min((1 << 63) - 1, -(1 << 63) + min(1.0, sample / n) * (1 << 64))) for l, n in sizes.items()}
    within = F.coalesce(*[F.when(F.col("l") == l, F.lit(h)) for l, h in limit.items()])
    picked = d.where(F.col("h") <= within).where("t is not null").select("l", "t")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part, texts in slices(batches, "t"):
            langs = part.column(0).to_pylist()
            for l in dict.fromkeys(langs):
                c = trigram_counts([t for t, x in zip(texts, langs) if x == l])
                sums[l] = sums[l] + c if l in sums else c
        for l, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(at), pa.string()), pa.array(at), pa.array(c[at].astype(np.int64))], ["l", "bucket", "n"])

    rows = picked.mapInArrow(count, "l string, bucket bigint, n bigint").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(rows["l"].unique())
    if not names:
        return Languages([], np.zeros((0, 1 << BITS)))
    counts = np.zeros((len(names), 1 << BITS))
    counts[[names.index(x) for x in rows["l"]], rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return Languages(names, counts)


def word_likelihoods(words: Words, model: Languages) -> tuple[np.ndarray, np.ndarray]:
    """(words, languages + 1) likelihoods scaled to at most 1 a word, and the logs of the scales."""
    g = Grams(words, SIZES, BITS)
    logs = np.empty((len(g.first) - 1, len(model.names) + 1), np.float64)
    logs[:, :-1] = segments(model.table[g.buckets], g.first, np.add)
    logs[:, -1] = np.diff(g.first) * (TEMPER * np.log(UNKNOWN))
    top = logs.max(1, initial=-np.inf)
    return np.exp(logs - top[:, None]).astype(np.float32)[g.inverse], top[g.inverse]


def em(p: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int = 8, pi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (documents, languages) within the allowed sets, from ``pi`` on if given; each document's log-likelihood under them; what more rounds can add to it at most."""
    n = np.diff(first)
    pi = allowed / np.maximum(allowed.sum(1, keepdims=True), 1) if pi is None else pi
    doc = np.repeat(np.arange(len(n)), n)
    for _ in range(rounds):
        old = pi
        r = p * pi.astype(np.float32)[doc]
        s = r.sum(1)
        r /= np.maximum(s, 1e-37)[:, None]
        pi = segments(r, first, np.add).astype(np.float64)
        pi /= np.maximum(pi.sum(1, keepdims=True), 1e-37)
    s = np.maximum((p * pi.astype(np.float32)[doc]).sum(1), 1e-37)
    # the log-likelihood is concave: no proportions gain more than n times the log of the largest step
    step = np.divide(pi, old, out=np.zeros_like(pi), where=old > 0).max(1)
    return pi, segments(np.log(s).astype(np.float64), first, np.add), n * np.log(np.maximum(step, 1))


def settled(p: np.ndarray, first: np.ndarray, allowed: np.ndarray, pi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``em`` until no document has more than GAIN left, ROUNDS rounds at most; from ``pi`` on, where given, it takes few."""
    step = done = 4 if pi is None else 1
    pi, ll, left = em(p, first, allowed, step, pi)
    while done < ROUNDS and len(more := np.flatnonzero(left > GAIN)):
        rows, start = _rows(first, more)
        step = min(2 * step, 8)
        pi[more], ll[more], left[more] = em(p[rows], start, allowed[more], step, pi[more])
        done += step
    return pi, ll


def _rows(first: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)[docs]
    start = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(first[docs] - start[:-1], n) + np.arange(start[-1]), start


def mixtures(texts: list[str], model: Languages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, languages + 1) proportions of the chosen sets, log-likelihoods a word, and words that have a letter."""
    words, k = Words(texts), len(model.names) + 1
    spoken = np.concatenate([[0], np.cumsum(words.folded > 57)])  # letters; a number says nothing about a language
    some = spoken[words.end] > spoken[words.start]
    first = np.concatenate([[0], np.cumsum(some)])[words.first]
    n = np.diff(first)
    if not some.any():
        return np.zeros((len(texts), k)), np.zeros(len(texts)), n
    p, top = (x[some] for x in word_likelihoods(words, model))
    scale = segments(top, first, np.add)
    allowed = np.ones((len(texts), k))
    pi, ll = settled(p, first, allowed)
    open_, active = allowed > 0, np.flatnonzero(n)  # languages that nothing was decided about
    while True:
        active = active[(allowed[active].sum(1) > 1) & open_[active].any(1)]
        if not len(active):
            break
        less = allowed[active]
        least = np.where(open_[active], pi[active], np.inf).argmin(1)
        less[np.arange(len(active)), least] = 0
        open_[active, least] = False
        rows, start = _rows(first, active)
        new_pi, new_ll = settled(p[rows], start, less, (near := (pi[active] + 1e-9) * less) / near.sum(1, keepdims=True))
        better = new_ll + PENALTY * np.log(n[active] + 1) >= ll[active]
        went = active[better]
        allowed[went], pi[went], ll[went] = less[better], new_pi[better], new_ll[better]
    pi[n == 0] = 0
    return pi, (ll + scale) / np.maximum(n, 1), n


def _accepted(pi: np.ndarray, n: np.ndarray, model: Languages) -> np.ndarray:
    return (n > 0) & (pi[:, -1] <= REJECT) if model.names else np.ones(len(n), bool)


def identified(docs: DataFrame, model: Languages) -> DataFrame:
    """``(doc_id, text)`` -> doc_id, main_lang, languages, shares, score, accepted: a row for each row of ``docs``.

    Languages stand by falling share, by name in a tie; shares are rounded to 4 places. ``score`` is the mean
    tempered log-likelihood a word. Texts without words of letters (null, empty, signs and numbers only) have no language, main_lang
    ``und``, and aren't accepted. Without any labelled row there is no model and everything is accepted as
    ``und``. Texts of any length are taken whole. Repeated rows come out alike, a null doc_id is kept, an empty
    table gives no rows, other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.names, UND])
        for part, texts in slices(batches):
            pi, score, n = mixtures([t or "" for t in texts], m)
            order = np.argsort(-np.round(pi, 4), axis=1, kind="stable")
            langs = [names[o[p[o] > 0]].tolist() for o, p in zip(order, np.round(pi, 4))]
            shares = [p[o[p[o] > 0]].tolist() for o, p in zip(order, np.round(pi, 4))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([x[0] if x else UND for x in langs]), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64())), pa.array(np.round(score, 4)), pa.array(_accepted(pi, n, m))],
                ["doc_id", "main_lang", "languages", "shares", "score", "accepted"],
            )

    return d.mapInArrow(run, "doc_id bigint, main_lang string, languages array<string>, shares array<double>, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: Languages) -> DataFrame:
    """The rows of ``docs`` that ``identified`` accepts, all columns as they are.

    Null, empty and wordless texts go; texts of any length are taken whole; repeated rows fare alike, null
    doc_ids don't matter, columns of any name pass through, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for part, texts in slices(batches):
            pi, _, n = mixtures([t or "" for t in texts], m)
            yield part.filter(pa.array(_accepted(pi, n, m)))

    return docs.mapInArrow(run, StructType(docs.schema.fields))


def op3_language_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(docs, fit(docs))

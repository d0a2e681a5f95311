"""Operator 5: benchmark decontamination by one Aho-Corasick automaton.

Questions and answers are normalised (lower case, runs of other signs to one space); the automaton holds
every window of WINDOW words of each item, so a passage of an item is found wherever it starts. Each
document is scanned once; places in the normalised text map to code points of the original.

The benchmark is broadcast and each Python worker builds the one automaton of it, which takes about 400 bytes
of memory a character (MEASURED_CHARS of benchmark are 3 GB; beyond that a warning says so). Test sets are
written by hand and don't grow with the corpus.
"""

from __future__ import annotations

import logging
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from chunkloom.llm._text import Words, chunks

WINDOW = 8  #: words; an item of fewer is looked for as a whole
LEAST = 4  #: default of ``least``: words below which an item isn't looked for, being an ordinary phrase
MEASURED_CHARS = 8 << 20

log = logging.getLogger(__name__)

_SCHEMA = "doc_id bigint, item_id bigint, start_char bigint, end_char bigint, n_words bigint"


def windows(text: str, least: int = LEAST) -> list[str]:
    """The padded windows of an item: those of WINDOW words, or the whole of a shorter one."""
    x = Words([text or ""])
    w = ["".join(map(chr, x.folded[a:b])) for a, b in zip(x.start, x.end)]
    if len(w) < max(1, least):
        return []
    n = min(WINDOW, len(w))
    return [" " + " ".join(w[i : i + n]) + " " for i in range(len(w) - n + 1)]


@lru_cache(2)
def automaton(items: tuple[tuple[int, str], ...], least: int = LEAST) -> ahocorasick.Automaton:
    at: dict[str, set[int]] = {}
    for item, text in items:
        for w in windows(text, least):
            at.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, of in at.items():
        a.add_word(w, (len(w), w.count(" ") - 1, tuple(sorted(of))))
    if len(a):
        a.make_automaton()
    return a


def spans(texts: list[str], a: ahocorasick.Automaton) -> list[tuple[int, int, int, int, int]]:
    """(text's number, item, start, end, words) of the maximal runs of windows of an item, in original code points."""
    if not len(a):
        return []
    x = Words(texts)
    word = x.folded != 0
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first separator after a word
    idx = np.flatnonzero(keep)
    f = x.folded[idx]
    f[f == 0] = 32
    flat = " " + f.tobytes().decode("utf-32-le", "surrogatepass")
    runs: dict[tuple[int, int, int], list[list[int]]] = {}
    for end, (length, n, items) in a.iter(flat):
        last = int(idx[end - 1])  # the separator that ends the last word
        first = int(idx[end - length + 1])
        w0 = int(np.searchsorted(x.start, first, "left"))
        doc = int(np.searchsorted(x.offs, first, "right")) - 1
        if last >= x.offs[doc + 1]:
            continue
        for item in items:
            of = runs.setdefault((doc, item, n), [])
            if of and w0 == of[-1][1] + 1:
                of[-1][1] = w0
            else:
                of.append([w0, w0])
    out = []
    for (doc, item, n), of in runs.items():
        for w0, w1 in of:
            out.append((doc, item, int(x.start[w0] - x.offs[doc]), int(x.end[w1 + n - 1] - x.offs[doc]), w1 - w0 + n))
    return sorted(out)


def _items(benchmark: DataFrame):
    """The named items with a text, broadcast."""
    b = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    items = tuple(sorted((r[0], r[1]) for r in b.collect()))
    if (chars := sum(len(t) for _, t in items)) > MEASURED_CHARS:
        log.warning("the automaton of %d characters of benchmark will take about %d MB in each Python worker", chars, chars * 400 >> 20)
    return benchmark.sparkSession.sparkContext.broadcast(items)


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """``(doc_id, text)``, ``(item_id, text)`` -> a row for each maximal run of an item's windows in a document.

    ``start_char`` and ``end_char`` are code points of the original text, end exclusive. Null or empty texts
    and items of fewer than ``least`` words give nothing; rows with a null doc_id are scanned and reported with
    a null doc_id; items with a null item_id are left out. Repeated documents are reported for each row;
    items of equal text each have their rows, and so have the windows of each length where an item_id repeats
    with several texts. Texts of any length are scanned whole. Empty tables give an empty result; other
    columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = _items(benchmark)

    def run(batches):
        a = automaton(shared.value, least)
        for batch, texts in chunks(batches):
            found = spans(texts, a)
            if found:
                ids = batch.column("doc_id").to_pylist()
                cols = list(zip(*((ids[d], *rest) for d, *rest in found)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start_char", "end_char", "n_words"])

    return d.mapInArrow(run, _SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` without a leak, all columns kept, by one scan and no shuffle.

    Each row is judged by its own text: other rows of its doc_id, and whether that is null, make no
    difference. Null and empty texts stay; texts of any length are scanned whole; columns of any name pass
    through; an empty table stays empty, and an empty benchmark drops nothing.
    """
    shared = _items(benchmark)

    def run(batches):
        a = automaton(shared.value, least)
        for batch, texts in chunks(batches):
            keep = np.ones(len(texts), bool)
            keep[[d for d, *_ in spans(texts, a)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, StructType(docs.schema.fields))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _oracle() -> str:
    """Windows of WINDOW words, and of each length from LEAST on for whole items of that length."""
    sizes = range(LEAST, WINDOW + 1)
    ahead = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, WINDOW))
    gram = lambda n: " || ' ' || ".join(["w", *(f"w{k}" for k in range(1, n))])
    return rf"""
WITH x AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^\p{{L}}\p{{N}}]*[\p{{L}}\p{{N}}]+') AS xs FROM documents),
u AS (SELECT r, doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS p FROM x),
t AS (SELECT r, doc_id, p, lower(regexp_extract(x, '[\p{{L}}\p{{N}}]+$')) AS w, length(regexp_extract(x, '[\p{{L}}\p{{N}}]+$')) AS n, CAST(sum(length(x)) OVER (PARTITION BY r ORDER BY p) AS BIGINT) AS e FROM u),
a AS (SELECT r, doc_id, p, w, {ahead} FROM t WINDOW o AS (PARTITION BY r ORDER BY p)),
d AS ({" UNION ALL ".join(f"SELECT r, doc_id, p, {n} AS n, {gram(n)} AS g FROM a WHERE w{n - 1} IS NOT NULL" for n in sizes)}),
b AS (SELECT item_id, list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+'), lambda v: lower(v)) AS v FROM benchmark WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT item_id, n, unnest(list_transform(generate_series(1, len(v) - n + 1), lambda i: array_to_string(v[i:i + n - 1], ' '))) AS g FROM (SELECT *, least(len(v), {WINDOW}) AS n FROM b WHERE len(v) >= {LEAST})),
h AS (SELECT r, doc_id, item_id, d.n, p FROM d JOIN g ON g.n = d.n AND g.g = d.g),
q AS (SELECT r, doc_id, item_id, n, min(p) AS p0, max(p) + n - 1 AS p1 FROM (SELECT *, p - row_number() OVER (PARTITION BY r, item_id, n ORDER BY p) AS z FROM h) GROUP BY r, doc_id, item_id, n, z)
SELECT q.doc_id, item_id, f.e - f.n AS start_char, l.e AS end_char, p1 - p0 + 1 AS n_words
FROM q JOIN t f ON f.r = q.r AND f.p = p0 JOIN t l ON l.r = q.r AND l.p = p1
"""


ORACLE = _oracle()

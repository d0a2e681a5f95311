"""Queries over chunk tables: filters, paging, lookup, lexical and vector ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import exprs as X
from chunkloom.operators.roles import KNOWLEDGE_ROLES

K1, B = 1.5, 0.75
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")


def filtered(chunks: DataFrame, text: str = "content", path: str = "heading_path", search: str | None = None, section: str | None = None, content_type: str | None = None, role: str | None = None, knowledge_only: bool = False, flagged: bool = False) -> DataFrame:
    """The chunks that satisfy every condition given; folding makes searches blind to case."""
    out = chunks
    if search:
        out = out.where(F.contains(X.casefold(text), X.casefold(F.lit(search))))
    if section:
        out = out.where(F.contains(X.casefold(F.array_join(path, " > ")), X.casefold(F.lit(section))))
    if content_type:
        out = out.where(F.col("content_type") == content_type)
    if role:
        out = out.where(F.col("semantic_role") == role)
    if knowledge_only:
        out = out.where(F.col("semantic_role").isin(*KNOWLEDGE_ROLES))
    if flagged:
        out = out.where(F.size("flags") > 0)
    return out


def page(chunks: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 50, most: int = 500) -> DataFrame:
    return chunks.orderBy(*order).offset(max(0, offset)).limit(max(0, min(limit, most)))


def find(chunks: DataFrame, selector: str, chunk_id: str = "id", index: str = "chunk_index", order: list[str] | None = None, pattern: bool = False) -> DataFrame:
    """At most one row: equal id, else equal index, else position, else part of an id; the first in order.

    With ``pattern`` the part is one of LIKE: _ stands for any sign, % for any number of them.
    """
    order = order or [index, chunk_id]
    i = F.col(chunk_id).cast("string")
    n = F.lit(selector).try_cast("bigint")
    part = i.like(f"%{selector}%") if pattern else F.contains(i, F.lit(selector))
    ranked = chunks.where(F.coalesce((i == selector) | (F.col(index) == n) | part, F.lit(False)))
    rank = F.when(i == selector, 0).when(F.col(index) == n, 1).otherwise(3)
    hit = ranked.withColumn("_rank", rank)
    if selector.isdigit():
        nth = chunks.orderBy(*order).offset(int(selector)).limit(1).withColumn("_rank", F.lit(2))
        hit = hit.unionByName(nth)
    return hit.orderBy("_rank", *order).limit(1).drop("_rank")


def previews(documents: DataFrame, chunks: DataFrame, doc: str = "document_id", chunk_id: str = "id", order: str = "chunk_index", start: str = "start_offset", end: str = "end_offset", section: str = "section", kind: str = "content_type") -> DataFrame:
    """``documents`` with ``spans``, where its chunks begin and end in its text, in their order; [] for a document without chunks."""
    span = F.struct(F.col(order).alias("chunk_index"), F.col(chunk_id).alias("chunk_id"), F.col(start).alias("start"), F.col(end).alias("end"), F.col(section).alias("section"), F.col(kind).alias("content_type"))
    spans = chunks.groupBy(doc).agg(F.array_sort(F.collect_list(span)).alias("spans"))  # chunks of one document
    return documents.join(spans, doc, "left").withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))


def terms_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    words = F.regexp_extract_all(X.casefold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return texts.select(F.col(key).alias("key"), F.explode(words).alias("term")).where(~F.col("term").isin(*STOPWORDS))


def bm25(corpus: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, top: int = 3) -> DataFrame:
    """``(query, key, score, rank)``: the ``top`` texts of each query; equal scores stand in order of key.

    Postings are restricted to the queries' terms before anything is joined, term frequencies are combined
    map-side, and document lengths travel with the postings.
    """
    q = terms_of(queries, query_key, query_text).distinct().withColumnRenamed("key", "query")
    words = F.filter(F.regexp_extract_all(X.casefold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))
    d = corpus.select(F.col(key).alias("key"), words.alias("w"))
    d = d.select("key", F.size("w").alias("length"), "w")
    total = d.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    tf = d.select("key", "length", F.explode("w").alias("term")).join(q.select("term").distinct(), "term", "left_semi").groupBy("term", "key", "length").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(df, "term").crossJoin(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    s = q.join(scored.select("term", "key", weight.alias("weight")), "term").groupBy("query", "key").agg(F.round(F.sum("weight"), 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= top)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _best(query: np.ndarray, cosine: np.ndarray, key: np.ndarray, top: int) -> np.ndarray:
    """The places of each query's ``top`` highest cosines; of equal ones those of the smallest keys."""
    order = np.lexsort((key, -cosine, query))
    q = query[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < top]


def cosine_top(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, top: int = 5, block: int = 4096) -> DataFrame:
    """``(query, key, cosine, rank)`` by full scan; the query itself isn't its own neighbour.

    Queries are broadcast in blocks of ``block`` and multiplied with Arrow batches in tiles of 256 by 1024, so a
    task's memory doesn't grow with their number; it keeps the best of what it saw, so no pair leaves it but ``top`` for each query. Null vectors and those of another length than
    the query have no cosine; a zero vector has 0.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and key is not null")
    q = queries.select(F.col(query_key).cast("bigint").alias("query"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and query is not null")
    blocks, out = max(1, -(-q.count() // block)), None
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toArrow().sort_by("query")
        shared = spark.sparkContext.broadcast((rows.column("query").to_numpy(), rows.column("v").combine_chunks()))
        found = v.mapInArrow(_scan(shared, top), "query bigint, key bigint, cosine double")
        out = found if out is None else out.unionByName(found)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "key"))).where(F.col("rank") <= top)


def _scan(shared, top: int):
    def by_length(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        n, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
        first = np.cumsum(n) - n
        out = {}
        for d in np.unique(n):
            at = np.flatnonzero(n == d)
            x = flat[first[at][:, None] + np.arange(d)]
            out[int(d)] = at, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return out

    def run(batches):
        ids, column = shared.value
        tiles = {d: [(at[i : i + 256], x[i : i + 256]) for i in range(0, len(at), 256)] for d, (at, x) in by_length(column).items()}
        worst = np.full(len(ids), -np.inf)  # the last cosine of each query's full list
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        best = {(d, t): none for d, mine in tiles.items() for t in range(len(mine))}
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys = part.column(0).to_numpy()
                for d, (at, x) in by_length(part.column(1)).items():
                    for t, (mine, units) in enumerate(tiles.get(d, ())):
                        s = np.round(units @ x.T, 6)
                        s[ids[mine][:, None] == keys[at]] = -np.inf
                        # no more than the best of this tile can come in, equal ones aside
                        least = np.partition(s, len(at) - top, axis=1)[:, -top] if len(at) > top else np.full(len(mine), -1.5)
                        r, c = np.nonzero(s >= np.maximum(np.maximum(worst[mine], least), -1.5)[:, None])
                        if len(r):
                            query, near, cosine = (np.concatenate(p) for p in zip(best[d, t], (mine[r], keys[at[c]], s[r, c])))
                            keep = _best(query, cosine, near, top)
                            query, near, cosine = best[d, t] = query[keep], near[keep], cosine[keep]
                            n = np.bincount(query, minlength=len(ids))
                            full = np.flatnonzero(n >= top)
                            worst[full] = cosine[np.cumsum(n)[full] - 1]
        for query, near, cosine in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(near), pa.array(cosine)], ["query", "key", "cosine"])

    return run

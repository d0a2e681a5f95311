"""Corpus-wide operators over chunk tables: order, duplicates, statistics, validation, coverage.

Everything here is joins, windows and aggregates; keys are named by parameters, so the operators work on any
table of ordered texts. Columns that aren't named pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from chunkloom.functions import exprs as X
from chunkloom.operators.roles import KNOWLEDGE_ROLES
from chunkloom.plans.lineage import cut, small_side
from chunkloom.plans.skew import named


def neighbours(chunks: DataFrame, doc: str, order: str, chunk_id: str) -> DataFrame:
    w = Window.partitionBy(doc).orderBy(order, chunk_id)
    return chunks.withColumns({"previous_chunk": F.lag(chunk_id).over(w), "next_chunk": F.lead(chunk_id).over(w)})


def parents(chunks: DataFrame, doc: str, order: str, path: str, level: str = "section") -> DataFrame:
    """``section_index`` and ``parent_id``: consecutive chunks of one heading path share a parent; level section, document or none."""
    if level == "none":
        return chunks.withColumns({"section_index": F.lit(None).cast("int"), "parent_id": F.lit(None).cast("string")})
    if level == "document":
        return chunks.withColumns({"section_index": F.lit(0), "parent_id": F.col(doc).cast("string")})
    w = Window.partitionBy(doc).orderBy(order)
    new = F.coalesce(F.col(path) != F.lag(path).over(w), F.lit(True)).cast("int")
    index = F.sum(new).over(w).cast("int") - 1
    return chunks.withColumn("section_index", index).withColumn("parent_id", X.section_id(F.col(doc).cast("string"), path, F.col("section_index")))


def reindex(chunks: DataFrame, doc: str, order: str, chunk_id: str) -> DataFrame:
    """Positions from 0, totals and neighbours anew, as after dropping rows."""
    w = Window.partitionBy(doc).orderBy(order, chunk_id)
    fresh = chunks.withColumns({"chunk_index": (F.row_number().over(w) - 1).cast("int"), "total_chunks": F.count("*").over(Window.partitionBy(doc)).cast("int")})
    return neighbours(fresh, doc, "chunk_index", chunk_id)


def exact_duplicates(chunks: DataFrame, chunk_id: str, text: str, order: list[str], scope: list[str] | None = None, min_length: int = 40) -> DataFrame:
    """``duplicate_of``: the first chunk of equal folded text; short texts are never duplicates."""
    long = F.length(F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))) >= min_length
    w = Window.partitionBy(*(scope or []), "_hash").orderBy(*order, chunk_id)
    # short texts get hashes of their own, so that no partition gathers them
    keyed = chunks.withColumn("_hash", F.when(long, X.content_hash(text)).otherwise(F.concat(F.lit("#"), F.col(chunk_id).cast("string"))))
    first = F.first(chunk_id).over(w)
    return keyed.withColumn("duplicate_of", F.when(first != F.col(chunk_id), first)).drop("_hash")


#: Prefix shingles that more texts share than this come last in all prefixes; twice as many where there are over HOT_MOST of them.
HOT, HOT_MOST = 8, 1 << 20
#: Prefixes are longer by this share of a set, and as many shingles must be shared within them.
SHARED = 0.05


def _ragged(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a column of int64 lists, the row of each, and the rows' lengths; null is an empty list."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.repeat(np.arange(len(n)), n), n


def _lists(values: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(values))


def _grams(words: np.ndarray, row: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row's runs of ``size`` words (of all its words, where it has fewer), sorted, and their rows."""
    end = np.cumsum(n)
    h, left = np.zeros(len(words), np.uint64), end[row] - np.arange(len(words))
    for k in range(size):
        # words beyond the row's end count as none
        w = np.zeros(len(words), np.uint64)
        if k < len(words):
            w[: len(words) - k] = words[k:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.where(left > k, w | np.uint64(1), np.uint64(0))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    first = left == n[row]
    whole = (left >= size) | first
    h, row = (h[whole] ^ (h[whole] >> np.uint64(30))).view(np.int64), row[whole]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], row[fresh]


def hashed_shingles(texts: DataFrame, key: str, text: str, size: int = 5) -> DataFrame:
    """``(key, s)``: the sorted hashes of the distinct word n-grams, see X.shingles; texts without words are left out."""
    words = F.transform(F.regexp_extract_all(X.casefold(text), F.lit(X.WORDS), F.lit(0)), lambda w: F.xxhash64(w))

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                h, row = _grams(*_ragged(batch.column(1)), size)
                n = np.bincount(row, minlength=batch.num_rows)
                some = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), _lists(h, n[n > 0])], ["key", "s"])

    named_ = texts.select(F.col(key).alias("key"), words.alias("w"))
    return named_.mapInArrow(run, StructType([named_.schema["key"], StructField("s", ArrayType(LongType()))]))


def _without(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` whose key is (left_semi) or isn't (left_anti) among ``keys``, which are broadcast where they are few."""
    return rows.join(small_side(keys, keys.count()), "key", how)


def shingle_classes(texts: DataFrame, key: str, text: str, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """Texts by their shingle sets: ``(key, s, n)`` of the first of each class of equal sets, and ``(rep, key)`` of the others.

    ``s`` are the sorted hashes of the distinct shingles, made within the row and written once; a class is known
    by 128 bits of hash, so copies meet as counts. Texts without shingles belong nowhere.
    """
    s = cut(hashed_shingles(texts, key, text, size).select("key", "s", F.xxhash64("s").alias("h1"), F.xxhash64("s", F.lit(1)).alias("h2")))
    copies = cut(s.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count("*").alias("copies")))
    others = cut(named(s.select("key", "h1", "h2"), copies, "key", ["h1", "h2"]).where("key <> rep").select("rep", "key"))
    return _without(s, others.select("key"), "left_anti").select("key", "s", F.size("s").alias("n")), others


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) whose sets reach the threshold, with their similarity."""
    pairs = cut(pairs.select("a", "b"))
    sets = _without(sets, cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()), "left_semi")
    side = lambda k: sets.select(F.col("key").alias(k), F.col("s").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
                (x, _, nx), (y, _, ny) = _ragged(batch.column(2)), _ragged(batch.column(3))
                x, y, ex, ey = x.view(np.int64), y.view(np.int64), np.cumsum(nx), np.cumsum(ny)
                same = np.empty(len(nx))
                for i in range(len(nx)):
                    s, other = x[ex[i] - nx[i] : ex[i]], y[ey[i] - ny[i] : ey[i]]
                    same[i] = np.count_nonzero(s[np.minimum(np.searchsorted(s, other), len(s) - 1)] == other)
                j = same / (nx + ny - same)
                some = pa.array(np.flatnonzero(j >= threshold))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(j).take(some)], ["a", "b", "similarity"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, StructType([*both.select("a", "b").schema.fields, StructField("similarity", DoubleType())]))


def _with_copies(pairs: DataFrame, others: DataFrame) -> DataFrame:
    return pairs.unionByName(others.select(F.col("rep").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity")))


def _prefixes(sets: DataFrame, threshold: float, last: np.ndarray) -> DataFrame:
    """``(key, n, shingle)``: the first n - ceil(threshold * n) + l shingles of each set, l = 1 + floor(SHARED * n), in the order of their hashes, those in ``last`` (sorted) after all others."""

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
                h, row, n = _ragged(batch.column(1))
                h = h.view(np.int64)
                late = np.zeros(len(h), bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
                before = np.concatenate([[0], np.cumsum(late)])
                start = np.cumsum(n) - n
                own = before[:-1] - before[start][row]
                place = np.where(late, (n - (before[start + n] - before[start]))[row] + own, np.arange(len(h)) - start[row] - own)
                kept = place < (n - np.ceil(n * threshold - 1e-9) + 1 + np.floor(n * SHARED))[row]
                r = pa.array(row[kept])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(r), pa.array(n.astype(np.int32)).take(r), pa.array(h[kept])], ["key", "n", "shingle"])

    return sets.select("key", "s").mapInArrow(run, StructType([sets.schema["key"], StructField("n", IntegerType()), StructField("shingle", LongType())]))


def _frequent(sets: DataFrame, threshold: float) -> np.ndarray:
    """Shingles that many prefixes would hold, sorted: put last, they make room for the next, which may be frequent too."""
    last = np.zeros(0, np.int64)
    for _ in range(2):
        most = HOT
        df = cut(_prefixes(sets, threshold, last).groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") > most))
        # those that are last already and still stand in prefixes have no better place
        while df.where(F.col("df") > most).count() > HOT_MOST:
            most *= 2
        found = df.where(F.col("df") > most).select("shingle").toArrow().column(0)
        if not len(found):
            break
        last = np.union1d(last, found.to_numpy())
    return last


def near_pairs(texts: DataFrame, key: str, text: str, threshold: float, size: int = 5) -> DataFrame:
    """``(a, b, similarity)``, a < b: the first text of each class of equal shingle sets with each of its copies, and
    the first texts of all classes whose sets reach the threshold, by a prefix-filtered join.

    Two sets of Jaccard similarity t share l of the first n - ceil(t * n) + l shingles of each, in any order of all
    shingles, or all that they share where that is less; only those are counted and joined. The order is that
    of the hashes, but shingles that many prefixes would hold stand last in every one.
    """
    sets, others = shingle_classes(texts, key, text, size)
    p = _prefixes(sets, threshold, _frequent(sets, threshold))
    a, b = p.select("shingle", F.col("key").alias("a"), F.col("n").alias("na")), p.select("shingle", F.col("key").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)
    enough = F.least(1 + F.floor(F.least("na", "nb") * SHARED), F.ceil(F.greatest("na", "nb") * threshold - 1e-9))
    pairs = a.join(b, "shingle").where(fits).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared")).where(F.col("shared") >= enough)
    return _with_copies(_verified(pairs, sets, threshold), others)


def minhash_bands(num_perm: int, threshold: float) -> tuple[int, int]:
    """Bands and rows, their product num_perm, whose threshold comes nearest."""
    rows = [r for r in range(1, num_perm + 1) if num_perm % r == 0]
    r = min(rows, key=lambda r: abs((r / num_perm) ** (1 / r) - threshold))
    return num_perm // r, r


def signatures(sets: DataFrame, num_perm: int = 64, columns: list[str] | None = None) -> DataFrame:
    """``signature``: the least value of each of ``num_perm`` hash functions over ``s``, an array of hashes that isn't empty."""
    rng = np.random.default_rng(1)
    mul, add = rng.integers(1, 1 << 63, num_perm, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, num_perm, dtype=np.uint64)
    keep = columns or [c for c in sets.columns if c != "s"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column(batch.num_columns - 1)
                h = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                first = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())[:-1]])
                out = np.empty((batch.num_rows, num_perm), np.uint64)
                for k in range(num_perm):
                    x = h * mul[k] + add[k]
                    x ^= x >> np.uint64(31)
                    out[:, k] = np.minimum.reduceat(x * np.uint64(0x94D049BB133111EB), first)
                sig = pa.FixedSizeListArray.from_arrays(pa.array(out.view(np.int64).ravel()), num_perm).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sig], [*keep, "signature"])

    fields = sets.select(*keep).schema.fields
    return sets.select(*keep, "s").mapInArrow(run, StructType([*fields, StructField("signature", ArrayType(LongType()))]))


def estimated_jaccard(a: Column | str, b: Column | str) -> Column:
    """The share of places in which two signatures agree; 0 for signatures of different lengths or empty ones."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(F.lit(0.0))


def minhash_pairs(texts: DataFrame, key: str, text: str, threshold: float, size: int = 5, num_perm: int = 64) -> DataFrame:
    """As near_pairs, with candidates from banded MinHash signatures and exact verification."""
    sets, others = shingle_classes(texts, key, text, size)
    bands, rows = minhash_bands(num_perm, threshold - 0.1)
    band = F.array(*[F.xxhash64(F.lit(b), *[F.col("signature")[b * rows + r] for r in range(rows)]) for b in range(bands)])
    k = cut(signatures(sets.select("key", "s"), num_perm).select("key", F.explode(band).alias("band")))
    pairs = k.select("band", F.col("key").alias("a")).join(k.select("band", F.col("key").alias("b")), "band").where("a < b").select("a", "b").distinct()
    return _with_copies(_verified(pairs, sets, threshold), others)


def greedy_originals(pairs: DataFrame) -> DataFrame:
    """``(a, b, similarity)``, a before b -> ``(dup, original, similarity)`` in order of first come, first kept.

    A text is a duplicate of the earliest kept text it is similar to; duplicates are nobody's original. Pairs of
    similarity 1 may name the first of equal texts alone: a copy of a duplicate goes to the same original. In
    each round the texts whose earlier neighbours are all decided are decided; rounds follow the longest
    chain of mutually undecided neighbours, and each is a written table.
    """
    every = cut(pairs.select("a", "b", "similarity").distinct())
    # copies wait for what becomes of the first of them
    twins = every.where("similarity = 1").groupBy("b").agg(F.min("a").alias("a"))
    p = cut(every.join(twins.select(F.col("b").alias("a")), "a", "left_anti").join(twins.select("b"), "b", "left_anti"))
    out, rounds = None, 0
    while not p.isEmpty():
        # kept for certain: those that are nobody's later neighbour any more
        later = p.select(F.col("b").alias("id")).distinct()
        kept = p.select(F.col("a").alias("id")).distinct().join(later, "id", "left_anti")
        w = Window.partitionBy("b").orderBy("a")
        # a text may go now if its earliest remaining neighbour is kept: no earlier one could come
        first = p.withColumn("n", F.row_number().over(w)).where("n = 1")
        found = cut(first.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("dup"), F.col("a").alias("original"), "similarity"))
        named = found.withColumn("_round", F.lit(rounds))  # a projection: constraints of a checkpoint don't survive a union
        rounds += 1
        out = named if out is None else out.unionByName(named)
        gone = found.select(F.col("dup").alias("id"))
        p = p.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        p = cut(p)
    found = out.drop("_round") if out is not None else p.select(F.col("b").alias("dup"), F.col("a").alias("original"), "similarity")
    of = found.select(F.col("dup").alias("a"), "original", F.col("similarity").alias("_s"))
    copies = twins.join(of, "a", "left").select(F.col("b").alias("dup"), F.coalesce("original", "a").alias("original"), F.coalesce("_s", F.lit(1.0)).alias("similarity"))
    return found.unionByName(copies)


def size_statistics(chunks: DataFrame, size: str, by: list[str] | None = None) -> DataFrame:
    c = F.col(size)
    return chunks.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("total"), F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias("mean"),
        F.round(F.coalesce(F.percentile(c, F.lit(0.5)), F.lit(0.0)), 4).alias("median"), F.coalesce(F.min(c), F.lit(0)).cast("bigint").alias("smallest"), F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias("largest"),
        F.round(F.coalesce(F.percentile(c, F.lit(0.95)), F.lit(0.0)), 4).alias("p95"), F.round(F.coalesce(F.stddev_pop(c), F.lit(0.0)), 4).alias("deviation"),
    )


def histogram(values: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """Equal-width bins, empty ones too; the last is closed. Equal values give one bin; no rows give none."""
    v = values.select(F.col(column).cast("double").alias("v")).where("v is not null")
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    spark = values.sparkSession
    if lo is None or lo == hi:
        return spark.createDataFrame([] if lo is None else [(0, lo, hi, v.count())], "bin int, lower double, upper double, n bigint")
    width = (hi - lo) / bins
    counts = v.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * width).alias("lower"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def breakdown(chunks: DataFrame, key: Column, missing: str, top: int | None = None) -> DataFrame:
    out = chunks.groupBy(F.coalesce(F.nullif(key, F.lit("")), F.lit(missing)).alias("key")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "key").limit(top) if top else out


def flag_counts(chunks: DataFrame, flags: str | Column) -> DataFrame:
    return chunks.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def knowledge_counts(chunks: DataFrame, role: str = "semantic_role") -> DataFrame:
    """One row: chunks of roles that carry knowledge, and the others."""
    known = F.coalesce(F.col(role).isin(*KNOWLEDGE_ROLES), F.lit(False))
    return chunks.agg(F.count_if(known).alias("knowledge"), F.count_if(~known).alias("metadata"))


def distinct_terms(chunks: DataFrame, terms: str, by: str) -> DataFrame:
    return chunks.select(F.col(by).alias("field"), F.explode(terms).alias("t")).groupBy("field").agg(F.countDistinct(X.casefold("t")).alias("n"))


def validate(chunks: DataFrame, chunk_id: str = "id", text: str = "content", doc: str = "document_id", size: str = "size", before: str = "previous_chunk", after: str = "next_chunk", duplicate_of: str | None = None, flags: str | None = None, least: int = 100, most: int = 800, max_duplicates: float = 0.25) -> DataFrame:
    """``(level, code, chunk_id)`` rows: what is wrong with a dataset. One row, EMPTY_DATASET, for an empty one."""
    i = F.col(chunk_id).cast("string")
    blank = lambda x: F.coalesce(F.regexp_replace(F.col(x).cast("string"), r"\s+", ""), F.lit("")) == ""
    issue = lambda level, code: F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))
    on = {("error", "MISSING_ID"): blank(chunk_id), ("error", "EMPTY_CONTENT"): blank(text), ("warning", "MISSING_DOCUMENT_ID"): blank(doc), ("warning", "OVERSIZED"): F.col(size) > most, ("warning", "UNDERSIZED"): F.col(size) < least}
    found = [F.when(F.coalesce(test, F.lit(False)), issue(*name)) for name, test in on.items()]
    if flags:
        found += [F.when(F.coalesce(F.array_contains(flags, f), F.lit(False)), issue("warning", f.upper())) for f in ("code_split", "broken_sentence")]
    rows = chunks.select(i.alias("chunk_id"), F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.level", "x.code", "chunk_id")
    # ids, counted once, say which are there twice and which neighbours are there at all
    ids = cut(chunks.select(i.alias("chunk_id")).where("chunk_id is not null").groupBy("chunk_id").count())
    twice = ids.where("count > 1").select(F.lit("error").alias("level"), F.lit("DUPLICATE_ID").alias("code"), "chunk_id")
    named_ = chunks.select(i.alias("chunk_id"), F.explode(F.array_compact(F.array(F.col(before).cast("string"), F.col(after).cast("string")))).alias("_known"))
    broken = named_.join(ids.select(F.col("chunk_id").alias("_known")), "_known", "left_anti").select(F.lit("error").alias("level"), F.lit("BROKEN_NEIGHBOR").alias("code"), "chunk_id")
    copies = F.count_if(F.col(duplicate_of).isNotNull()) if duplicate_of else F.lit(0)
    whole = chunks.agg(F.count("*").alias("n"), copies.alias("copies"))
    about = F.array_compact(F.array(F.when(F.col("n") == 0, issue("warning", "EMPTY_DATASET")), F.when(F.col("copies") > max_duplicates * F.col("n"), issue("warning", "HIGH_DUPLICATION"))))
    whole = whole.select(F.explode(about).alias("x")).select("x.level", "x.code", F.lit(None).cast("string").alias("chunk_id"))
    return rows.unionByName(twice).unionByName(broken).unionByName(whole)


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("level", "code").agg(F.count("*").alias("n"))


_ALNUM = r"[\p{L}\p{N}]+"


def _vocabulary(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(X.casefold(text), F.lit(_ALNUM), F.lit(0)))


def coverage(blocks: DataFrame, pieces: DataFrame, share: float = 0.6, least: int = 3, strict: bool = False) -> DataFrame:
    """Where each source block went: blocks ``(doc, block, text)``, pieces ``(doc, destination, text)``.

    A block counts for the first of knowledge, metadata and retrieval_terms whose vocabulary within the
    document holds at least ``share`` of its distinct words, else as dropped. Blocks of fewer than ``least``
    words count as knowledge (with ``strict`` they are measured too). Vocabularies are rows and meet the
    blocks' words in an equi-join, so no document's words have to fit into one value.
    """
    b = blocks.select("doc", "block", F.size(F.regexp_extract_all("text", F.lit(_ALNUM), F.lit(0))).alias("words"), _vocabulary(F.col("text")).alias("v"))
    words = b.select("doc", "block", F.explode("v").alias("word"))
    known = pieces.select("doc", "destination", F.explode(_vocabulary(F.col("text"))).alias("word")).distinct()
    hits = words.join(known, ["doc", "word"]).groupBy("doc", "block").pivot("destination", ["knowledge", "metadata", "retrieval_terms"]).count()
    n = F.size("v")
    part = {d: F.coalesce(F.col(d), F.lit(0)) / n for d in ("knowledge", "metadata", "retrieval_terms")}
    tiny = F.lit(False) if strict else F.col("words") < least
    where = F.when(tiny | (n == 0), F.lit("knowledge"))
    for d, p in part.items():
        where = where.when(p >= share, F.lit(d))
    where = where.otherwise("dropped")
    rate = F.when(tiny | (n == 0), F.lit(1.0)).otherwise(F.round(F.coalesce(*[F.when(where == d, p) for d, p in part.items()], F.greatest(*part.values())), 3))
    return b.join(hits, ["doc", "block"], "left").select("doc", "block", F.col("words").cast("bigint").alias("words"), where.alias("destination"), rate.alias("coverage"))


def coverage_summary(dispositions: DataFrame, by: list[str] | None = None) -> DataFrame:
    d = F.col("destination")
    total, lost = F.sum("words"), F.sum(F.when(d == "dropped", F.col("words")).otherwise(0))
    return dispositions.groupBy(*(by or [])).agg(
        F.count("*").alias("blocks"), total.alias("words"), *[F.count_if(d == x).alias(f"{x}_blocks") for x in ("knowledge", "metadata", "retrieval_terms", "dropped")],
        lost.alias("dropped_words"), F.when(total > 0, F.round(1 - lost / total, 4)).otherwise(F.lit(1.0)).alias("retention"),
    )


def common_prefix(paths: DataFrame, group: str, path: str) -> DataFrame:
    """The longest heading path that all rows of a group share."""
    p = paths.select(group, path, F.posexplode_outer(path).alias("i", "name"))
    level = p.where("i is not null").groupBy(group, "i").agg(F.countDistinct("name").alias("d"), F.count("*").alias("n"), F.min("name").alias("name"))
    whole = paths.groupBy(group).agg(F.count("*").alias("rows"))
    ok = level.join(whole, group).withColumn("bad", ((F.col("d") > 1) | (F.col("n") < F.col("rows"))).cast("int"))
    ok = ok.withColumn("bad", F.max("bad").over(Window.partitionBy(group).orderBy("i"))).where("bad = 0")
    agg = ok.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]).alias("common"))
    return whole.join(agg, group, "left").select(group, F.coalesce("common", F.array().cast("array<string>")).alias("common"))

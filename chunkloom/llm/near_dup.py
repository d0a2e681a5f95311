"""Operator 7: MinHash near-duplicate groups with tensored banding.

Two collections of M half-keys, each of R minhashes, are drawn once; table (i, j) is keyed by half-key
i of the first and j of the second collection, so that M * M tables cost 2 * M * R minhashes instead of
M * M * 2 * R. Two texts share a table exactly if some half-key agrees in either collection.

Plan: (1) one scan computes per document a 128-bit hash of its word sequence and the half-keys; exact
copies collapse by a group-by on the hash. (2) Table keys meet in one shuffle; every bucket is linked
to its smallest id, and components of these links are a superset of the groups. Buckets that a sample shows
to be hot are linked in SALT parts first, and then the parts' smallest ids. (3) Only documents in components
are scanned again for their shingles; each component is verified where it lies: every pair that shares a
table and isn't yet linked is compared by exact Jaccard similarity. A component of more than BLOCK_BYTES of
shingles is first linked by verifying each document against its buckets' smallest ids; only documents that
still share a table with another group than their own go on, in blocks, all pairs of which are verified as
tasks of bounded size. (4) Components of the verified links are the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chunkloom.llm._frames import TASKS, free, slices
from chunkloom.llm._grams import bounded_sample
from chunkloom.llm._text import Words, binary, chunks, mix, segments, shingles
from chunkloom.llm.components import connected_components
from chunkloom.plans.lineage import cut, small_side
from chunkloom.plans.skew import named

SHINGLE = 3  #: words
THRESHOLD = 0.5  #: Jaccard similarity of shingle sets: every tenth word of a copy may differ
M, R = 12, 2  #: half-keys of a collection, minhashes of a half-key: a pair at 0.5 shares a table with 0.94, at 0.6 with 0.98
BLOCK_BYTES = 32 << 20
SAMPLE, HOT, SALT = 8192, 16, 64  #: documents that hot buckets are looked for in, how many of them make one hot, its parts
ROWS = 1 << 15  #: documents a task whose table keys are made, about
_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 1 << 63, 2 * M * R, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, 2 * M * R, dtype=np.uint64)


def minhashes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 2 * M * R) minhashes of the shingle hashes of each text."""
    out = np.zeros((len(first) - 1, 2 * M * R), np.uint64)
    for k in range(2 * M * R):
        x = h * _A[k] + _B[k]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = segments(x, first, np.minimum)
    return out


def half_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, 2 * M): the two collections of half-keys side by side."""
    mh = minhashes(h, first).reshape(-1, 2 * M, R)
    out = np.zeros(mh.shape[:2], np.uint64)
    for r in range(R):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + mh[:, :, r])
    return out.view(np.int64)


def _text_hashes(words: Words) -> list[np.ndarray]:
    """h1 and h2 of each text: its words in their order."""
    w, at = words.hashes(), np.arange(len(words.start)) - np.repeat(words.first[:-1], np.diff(words.first))
    return [segments(mix(w + at.astype(np.uint64) * np.uint64(c)), words.first, np.add).view(np.int64) for c in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)]


def _signatures(batches):
    for batch, texts in chunks(batches):
        words = Words(texts)
        h, first = shingles(words, SHINGLE)
        keys = half_keys(h, first)
        sums = _text_hashes(words)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sums[0]), pa.array(sums[1]), pa.array(np.diff(words.first)), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), 2 * M).cast(pa.list_(pa.int64()))],
            ["doc_id", "h1", "h2", "n_words", "keys"],
        )


def _sets(batches):
    for batch, texts in chunks(batches):
        words = Words(texts)
        h, first = shingles(words, SHINGLE)
        sets = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, _text_hashes(words)), binary(sets)], ["doc_id", "h1", "h2", "shingles"])


def _hashed(*names: str):
    def run(batches):
        for part, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, _text_hashes(Words([t or "" for t in texts])))], [*part.schema.names, *names])

    return run


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values."""
    both = len(a) + len(b) - len(np.union1d(a, b)) if len(a) * 8 > len(b) else int(np.isin(a, b).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) > both else 1.0


def verified_links(ids: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], threshold: float, labels: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the graph whose edges are the pairs that share a table and reach ``threshold``.

    Pairs already linked through others are not compared again, so a group of n copies costs about n
    comparisons; the components are those of comparing all the pairs. Equal ``labels`` are linked already.
    """
    root = list(range(len(ids)))
    if labels is not None:
        lead: dict[int, int] = {}
        root = [lead.setdefault(x, i) for i, x in enumerate(labels.tolist())]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links, failed = [], set()
    size = np.array([len(s) for s in sets])
    for i in range(M):
        for j in range(M):
            k = mix(keys[:, i].view(np.uint64) * np.uint64(3) + mix(keys[:, M + j].view(np.uint64)))
            order = np.argsort(k, kind="stable")
            cuts = np.flatnonzero(np.diff(k[order])) + 1
            for g in np.split(order, cuts):
                if len(g) < 2:
                    continue
                met: dict[int, list[int]] = {}
                for b in g.tolist():
                    for r in list(met):
                        mine = find(b)
                        if find(r) == mine:
                            continue
                        for a in met[r]:
                            pair = (a, b) if a < b else (b, a)
                            if pair in failed or min(size[a], size[b]) < threshold * max(size[a], size[b]):
                                continue
                            if jaccard(sets[a], sets[b]) >= threshold:
                                root[find(b)] = find(a)
                                links.append((int(ids[a]), int(ids[b])))
                                break
                            failed.add(pair)
                    merged: dict[int, list[int]] = {}
                    for r, members in met.items():
                        merged.setdefault(find(r), []).extend(members)
                    merged.setdefault(find(b), []).append(b)
                    met = merged
    return links


def _verify(table: pa.Table) -> pa.Table:
    ids = table.column("doc_id").to_numpy()
    keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(-1, 2 * M)
    sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
    labels = table.column("label").to_numpy() if "label" in table.column_names else None
    links = verified_links(ids, keys, sets, THRESHOLD, labels)
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _keyed(reps: DataFrame, *more: str) -> DataFrame:
    """A row for each document and table."""
    table = F.flatten(F.array(*[F.array(*[F.xxhash64(F.lit(i * M + j), F.col("keys")[i], F.col("keys")[M + j]) for j in range(M)]) for i in range(M)]))
    return reps.select("doc_id", *more, F.explode(table).alias("key"))


def _stars(reps: DataFrame) -> DataFrame:
    """Links (a, b) of the documents of each bucket to its smallest id; buckets of one vanish in the window's filter."""
    keyed = _keyed(reps)
    hot = cut(_keyed(bounded_sample(reps, "doc_id", SAMPLE)).groupBy("key").count().where(F.col("count") >= HOT).select("key", F.lit(SALT).alias("parts")))
    star = lambda k, by: k.withColumn("hub", F.min("doc_id").over(Window.partitionBy(*by))).where("hub <> doc_id").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    if hot.isEmpty():
        return star(keyed, ["key"])
    keyed = keyed.join(F.broadcast(hot), "key", "left")  # SAMPLE * M * M / HOT rows at most
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0)).alias("salt")
    heads = keyed.where("parts is not null").groupBy("key", salt).agg(F.min("doc_id").alias("doc_id"))
    return star(keyed.select("doc_id", "key", salt), ["key", "salt"]).unionByName(star(heads, ["key"]))


def _verified(d: DataFrame, reps: DataFrame, loose: DataFrame, n_loose: int) -> DataFrame:
    """Links (a, b) of Jaccard similarity THRESHOLD at least, a spanning forest of the groups."""
    # a repeated doc_id may have several texts: the signature's hash says which one is meant
    members = reps.join(loose.withColumnRenamed("id", "doc_id"), "doc_id").select("doc_id", "h1", "h2", "keys", "component")
    near = d.join(small_side(loose.select(F.col("id").alias("doc_id")), n_loose), "doc_id", "left_semi")
    sets = near.mapInArrow(_sets, "doc_id bigint, h1 bigint, h2 bigint, shingles binary").groupBy("doc_id", "h1", "h2").agg(F.min("shingles").alias("shingles"))
    members = cut(members.join(sets, ["doc_id", "h1", "h2"]).select("component", "doc_id", "keys", "shingles"))
    sizes = cut(members.groupBy("component").agg(F.ceil(F.sum(F.length("shingles") + 256) / F.lit(BLOCK_BYTES / 2)).cast("int").alias("blocks")).where("blocks > 1"))
    n_large = sizes.count()
    if not n_large:
        return members.groupBy("component").applyInArrow(_verify, "a bigint, b bigint")
    small = members.join(small_side(sizes, n_large), "component", "left_anti")
    large = members.join(small_side(sizes.select("component"), n_large), "component", "left_semi")
    by_hub, left = _large(large)
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    sizes = left.groupBy("component").agg(F.ceil(F.sum(F.length("shingles") + 256) / F.lit(BLOCK_BYTES / 2)).cast("int").alias("blocks"))
    pairs = left.join(sizes, "component").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("block", F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other"))
    in_blocks = pairs.select("component", "block", "doc_id", "keys", "shingles", "label").groupBy("component", "block").applyInArrow(_verify, "a bigint, b bigint")
    return small.groupBy("component").applyInArrow(_verify, "a bigint, b bigint").unionByName(by_hub).unionByName(in_blocks)


def _large(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of large components the links of documents to their buckets' smallest ids, and the documents that share a
    bucket with one of another group (``label``) after that: no other pair is left to compare."""
    star = cut(_stars(members.select("doc_id", "keys")).distinct())
    size = members.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    met = star.join(size, "a").join(size.select(F.col("a").alias("b"), F.col("sa").alias("sb")), "b")  # a hub's side is split by the adaptive plan

    def compare(batches):
        for batch in batches:
            of = [[np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3)]
            yield batch.select(["a", "b"]).filter(pa.array([jaccard(x, y) >= THRESHOLD for x, y in zip(*of)], pa.bool_()))

    links = cut(met.select("a", "b", "sa", "sb").mapInArrow(compare, "a bigint, b bigint"))
    label = connected_components(links).select(F.col("id").alias("doc_id"), F.col("component").alias("label"))
    labelled = cut(members.join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
    keyed = cut(_keyed(labelled, "label").select("doc_id", "key", "label"))
    mixed = keyed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_ = keyed.join(mixed, "key", "left_semi").select("doc_id").distinct()
    return links, labelled.join(open_, "doc_id", "left_semi")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, group_id, is_kept)``, a row for each distinct doc_id that isn't null.

    ``group_id`` is the smallest doc_id of the group. Case, punctuation and spacing don't count. A text
    without words (null, empty, signs only) is alone in its group. Rows that repeat a doc_id count as one
    document (the one of the smallest hash). Rows without doc_id can't be named and are left out. Of ties
    the smallest doc_id is kept. Other columns are ignored; an empty table gives an empty result. Whole
    texts are read whatever their length; one text's working memory is about 40 bytes a character.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    sig = d.mapInArrow(_signatures, "doc_id bigint, h1 bigint, h2 bigint, n_words bigint, keys array<bigint>")
    sig = cut(sig)
    sig = sig.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("h1", "h2"))).where("rn = 1").drop("rn")
    sig = cut(sig)  # partitioned by doc_id
    wordless = sig.where("n_words = 0").select("doc_id", F.col("doc_id").alias("rep"))
    text = ["h1", "h2", "n_words"]
    own = sig.where("n_words > 0")
    copies = cut(own.groupBy(*text).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    n_texts = copies.count()
    reps = own.join(copies.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "h1", "h2", "keys")
    reps = cut(reps.repartition(min(TASKS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_texts // ROWS)), "doc_id"))
    groups = cut(named(own.select("doc_id", *text), copies, "doc_id", text))
    loose = cut(connected_components(_stars(reps)))
    n_loose = loose.count()
    if n_loose:
        tight = connected_components(_verified(d, reps, loose, n_loose))
        groups = groups.join(tight.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("rep"))
    return groups.unionByName(wordless).select("doc_id", F.col("rep").alias("group_id"), (F.col("doc_id") == F.col("rep")).alias("is_kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each group left, all columns kept.

    Of rows that repeat a kept doc_id one stays (that of the smallest hash, whose text was compared). Rows with a null doc_id
    stay: they can't be told apart by id. Empty texts stay unless their doc_id repeats.
    """
    gone_id, again_id, number, h1, h2 = free(docs, "gone", "again", "number", "h1", "h2")
    groups = cut(near_duplicate_groups(docs))
    gone = groups.where(~F.col("is_kept")).select(F.col("doc_id").alias(gone_id))
    n_gone = gone.count()
    kept = docs.join(small_side(gone, n_gone), F.col("doc_id") == F.col(gone_id), "left_anti")
    ids = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again_id))
    ids = cut(ids)
    n_again = ids.count()
    if not n_again:
        return kept
    repeats = small_side(ids, n_again)
    twice = kept.join(repeats, F.col("doc_id") == F.col(again_id), "left_semi")
    once = kept.join(repeats, F.col("doc_id") == F.col(again_id), "left_anti")
    twice = twice.mapInArrow(_hashed(h1, h2), StructType([*twice.schema.fields, StructField(h1, LongType()), StructField(h2, LongType())]))
    first = Window.partitionBy("doc_id").orderBy(h1, h2, F.xxhash64(F.coalesce("text", F.lit(""))))
    return once.unionByName(twice.withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).drop(number, h1, h2))


def op7_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+2], ' ') END AS s
  FROM w, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2, x.n, y.n HAVING count(*) >= 0.5 * (x.n + y.n - count(*))
), r AS (SELECT doc_id AS id, doc_id AS g FROM documents WHERE doc_id IS NOT NULL UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.id)
SELECT id AS doc_id, min(g) AS group_id, id = min(g) AS is_kept FROM r GROUP BY id
"""

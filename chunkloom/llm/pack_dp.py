"""Operator 4: order-preserving packing by dynamic programming.

Documents stand in the order of doc_id. Windows of WINDOW tokens are cut between documents or between
sentences; the cuts minimise padding + SENTENCE_CUT for each window that ends inside a document + HARD_CUT
for each that ends inside a sentence (only a sentence of more than WINDOW tokens is cut there). Nothing is
lost and nothing changes places.

With S the running sum of tokens and e(j) the penalty of a cut at j, f(j) = e(j) + WINDOW - S(j) +
min {f(i) + S(i) : S(j) - S(i) <= WINDOW}. The candidates i form a sliding range, so a monotone queue of
increasing f + S gives each minimum in constant amortised time.

Plan: the running sum of characters in the order of doc_id cuts the corpus into shards of consecutive ids of
about SHARD_CHARS; it is exact and takes a range sort of ids, hashes and lengths alone. A second scan counts
tokens a sentence; only these numbers are shuffled, and each shard is one run of the programme. A shard's last
window is the only one that sharding can leave less full than one run over everything would.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm import _bpe
from chunkloom.llm._frames import by_shard, slices
from chunkloom.plans.lineage import cut

WINDOW = 2048
SENTENCE_CUT, HARD_CUT = 64, 512  #: in tokens of padding
SHARD_CHARS = 32 << 20
SHARDS = 1 << 19  #: at most, 24 bytes each in every worker; beyond 16 T characters a shard grows instead
FIRST = -(1 << 63)  #: where rows without doc_id stand

_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)
_SIGNS = np.zeros(0x3100, np.uint8)  # 1 space, 2 terminator, 3 closing sign, 4 terminator that needs no space
_SIGNS[_SPACES] = 1
_SIGNS[[ord(c) for c in ".!?…"]] = 2
_SIGNS[[ord(c) for c in "\"')]»”’"]] = 3
_SIGNS[ord("。")] = 4


def sentence_ends(cps: np.ndarray) -> np.ndarray:
    """Code points at which sentences end, the text's end last; white space begins the next sentence.

    A sentence ends after terminators (and closing signs) before white space, after ideographic ones, and
    before a line feed that doesn't follow white space.
    """
    n = len(cps)
    sign = np.where(cps < 0x3100, _SIGNS[np.minimum(cps, 0x30FF)], np.where((cps == 0xFF01) | (cps == 0xFF1F), 4, 0))
    body = np.maximum.accumulate(np.where(sign != 3, np.arange(n), 0))  # the last that is no closing sign
    end = np.zeros(n + 1, bool)
    space = sign[1:] == 1
    end[1:n] = space & ((sign[body[:-1]] == 2) | (cps[1:] == 10) & (sign[:-1] != 1))
    end[1:n] |= (sign[:-1] == 4) & (sign[1:] != 4)
    end[n] = True
    return np.flatnonzero(end)


def units(text: str, window: int, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, end characters and kinds of end of a text's units: 0 the text's, 1 a sentence's, 2 inside one.

    A unit is a sentence, or a part of at most ``window`` tokens of a longer one. A token belongs to the
    sentence in which it begins; a cut inside a sentence is put at the token's first whole character.
    """
    ids = _bpe.encode(text, path)
    if not len(ids):
        return (np.zeros(0, np.int64),) * 3
    size = _bpe.encoder(path)[1][ids]
    begin = np.cumsum(size) - size
    cps = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at_byte = None if text.isascii() else _bpe.byte_starts(cps)
    ends = sentence_ends(cps)
    until = np.searchsorted(begin, ends if at_byte is None else at_byte[ends])
    until[-1] = len(ids)
    keep = np.diff(until, prepend=0) > 0
    until, ends = until[keep], ends[keep]
    ends[-1] = len(text)
    kind = np.ones(len(until), np.int64)
    n = np.diff(until, prepend=0)
    if n.max() > window:
        parts = -(-n // window)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts) + 1
        base, last = np.repeat(until - n, parts), inner == np.repeat(parts, parts)
        new = np.where(last, np.repeat(until, parts), base + inner * window)
        inside = begin[np.minimum(new, len(ids) - 1)]
        chars = inside if at_byte is None else np.searchsorted(at_byte, inside)
        ends, kind, until = np.where(last, np.repeat(ends, parts), chars), np.where(last, 1, 2), new
        n = np.diff(until, prepend=0)
    kind[-1] = 0
    return n, ends, kind


def best_cuts(tokens: np.ndarray, kind: np.ndarray, window: int = WINDOW, sentence_cut: int = SENTENCE_CUT, hard_cut: int = HARD_CUT) -> list[int]:
    """The numbers of the units after which windows end; of equal costs the longest last window wins."""
    penalty = np.array([0, sentence_cut, hard_cut])[kind].tolist()
    s = [0, *np.cumsum(tokens).tolist()]
    f, back = [0] * len(s), [0] * len(s)
    queue: deque[int] = deque([0])  # f + s increases from left to right
    for j in range(1, len(s)):
        least = s[j] - window
        while s[queue[0]] < least:
            queue.popleft()
        i = queue[0]
        f[j] = penalty[j - 1] + window - s[j] + f[i] + s[i]
        back[j] = i
        g = f[j] + s[j]
        while queue and f[queue[-1]] + s[queue[-1]] > g:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(s) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def shards_of(keyed: DataFrame, chars: int = SHARD_CHARS) -> list[tuple[int, int, int]]:
    """``(i, h, salt, n)`` -> the first key (i, h, salt) of each shard: runs of about ``chars`` in the order of the keys.

    A row's shard follows from the sum of all n before it, so it depends neither on sampling nor on the number
    of partitions. Equal (i, h) are equal rows, and the salt keeps any number of them from one task.
    """
    spark = keyed.sparkSession
    narrow = cut(keyed)
    total = narrow.agg(F.sum("n")).first()[0]
    if not total:
        return []
    chars = max(chars, -(-total // SHARDS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = narrow.repartitionByRange(parts, "i", "h", "salt").sortWithinPartitions("i", "h", "salt").withColumn("part", F.spark_partition_id())

    def running(batches):
        before = 0
        for batch in batches:
            n = batch.column(3).to_numpy()
            yield batch.set_column(3, "n", pa.array(before + np.cumsum(n) - n)).append_column("own", batch.column(3))
            before += int(n.sum())

    placed = cut(ordered.mapInArrow(running, "i bigint, h bigint, salt bigint, n bigint, part int, own bigint"))
    sums, offsets = placed.groupBy("part").agg(F.sum("own")).collect(), []  # a row a partition
    for part, own in sorted(sums):
        offsets.append((part, sum_before := (offsets[-1][1] + last if offsets else 0)))
        last = own
    offset = spark.createDataFrame(offsets, "part int, sum_before bigint")
    at = placed.join(F.broadcast(offset), "part").withColumn("shard", F.floor((F.col("n") + F.col("sum_before")) / F.lit(chars)))
    firsts = at.groupBy("shard").agg(F.min(F.struct("i", "h", "salt")).alias("first")).select("first.*").collect()
    return sorted(map(tuple, firsts))


def shard_numbers(firsts: list[tuple[int, int, int]], ids: np.ndarray, h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The number of the last of ``firsts`` that isn't after each key."""
    heads = np.array([f[0] for f in firsts], np.int64)
    lo, hi = np.searchsorted(heads, ids, "left"), np.searchsorted(heads, ids, "right")
    out = hi - 1
    for r in np.flatnonzero(lo < hi).tolist():  # an id on which a shard begins
        out[r] = bisect_right(firsts, (int(ids[r]), int(h[r]), int(salt[r]))) - 1
    return np.maximum(out, 0)


_WINDOWS = "shard bigint, window bigint, n_tokens bigint, padding bigint, ends_inside boolean, doc_ids array<bigint>, start_chars array<bigint>, end_chars array<bigint>"


def packed(docs: DataFrame, window: int = WINDOW, sentence_cut: int = SENTENCE_CUT, hard_cut: int = HARD_CUT, tokenizer: str = _bpe.DEFAULT, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``(doc_id, text)`` -> a row for each window: its spans (doc_id, start and end character), tokens and padding.

    Windows are numbered in order within ``shard``, shards in order of their ids. Each document takes one
    more token, its end sign, which goes with its last sentence (or stands alone where that fills a window).
    Null and empty texts take no place and appear in no window. Rows without doc_id come first, their spans
    have a null for it; rows that repeat a doc_id (or have none) are packed one after the other, in the order
    of their texts' hashes, equal rows too. An empty table gives no rows; other columns are ignored; texts of
    any length are cut at sentences like the rest.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    place = F.coalesce("doc_id", F.lit(FIRST).cast("bigint"))
    d = d.select("doc_id", "text", place.alias("i"), F.xxhash64("text").alias("h"), (F.monotonically_increasing_id() % 1024).alias("salt"))
    firsts = shards_of(d.select("i", "h", "salt", (F.length("text") + 1).cast("bigint").alias("n")), shard_chars)
    shared = d.sparkSession.sparkContext.broadcast(firsts)

    def count(batches):
        starts = shared.value
        for part, texts in slices(batches):
            # the end sign needs a place in the last unit
            found = [units(t, window - 1, tokenizer) for t in texts]
            shard = shard_numbers(starts, *(part.column(k).to_numpy() for k in ("i", "h", "salt"))) if starts else np.zeros(len(texts), np.int64)
            columns = [pa.array(shard, pa.int64()), part.column("doc_id"), part.column("i"), part.column("h")]
            columns += [pa.array([x[k].astype(t).tobytes() for x in found], pa.binary()) for k, t in enumerate((np.int32, np.int64, np.int8))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "i", "h", "n", "ends", "kind"])

    counted = d.mapInArrow(count, "shard bigint, doc_id bigint, i bigint, h bigint, n binary, ends binary, kind binary")

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("i", "ascending"), ("h", "ascending")])
        n = [np.frombuffer(x, np.int32).astype(np.int64) for x in table.column("n").to_pylist()]
        last = np.cumsum([len(x) for x in n]) - 1
        size, ends, kind = np.concatenate(n), np.concatenate([np.frombuffer(x, np.int64) for x in table.column("ends").to_pylist()]), np.concatenate([np.frombuffer(x, np.int8) for x in table.column("kind").to_pylist()])
        size[last] += 1
        cuts = np.array(best_cuts(size, kind, window, sentence_cut, hard_cut))
        doc = np.repeat(np.arange(len(n)), [len(x) for x in n])
        begins = np.concatenate([[0], ends[:-1]])
        begins[np.concatenate([[0], last[:-1] + 1])] = 0
        # a span is the units that a document has in a window
        head = np.zeros(len(size) + 1, bool)
        head[np.concatenate([[0], last + 1])] = head[cuts] = True
        span = np.flatnonzero(head[:-1])
        until = np.append(span[1:], len(size)) - 1
        offsets = pa.array(np.searchsorted(span, np.concatenate([[0], cuts])), pa.int32())
        total = np.diff(np.concatenate([[0], np.cumsum(size)[cuts - 1]]))
        ids = table.column("doc_id").combine_chunks().take(pa.array(doc[span]))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (ids, pa.array(begins[span], pa.int64()), pa.array(ends[until], pa.int64()))]
        shard = pa.array(np.full(len(cuts), table.column("shard")[0].as_py()), pa.int64())
        return pa.Table.from_arrays(
            [shard, pa.array(np.arange(len(cuts))), pa.array(total), pa.array(window - total), pa.array(kind[cuts - 1] > 0), *lists],
            ["shard", "window", "n_tokens", "padding", "ends_inside", "doc_ids", "start_chars", "end_chars"],
        )

    return by_shard(counted.where("length(n) > 0"), "shard", len(firsts)).applyInArrow(pack, _WINDOWS)


def op4_pack_dp(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))

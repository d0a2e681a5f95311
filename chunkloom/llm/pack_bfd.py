"""Operator 8: best-fit-decreasing packing into token-id matrices.

Every text becomes ids plus an end sign; one of more than WINDOW ids is split into pieces, all but the last
full, so that nothing is lost. Pieces are placed in falling order of size, each into the open row with the
least room that still holds it. The rooms are found by a segment tree over the capacities 0 .. WINDOW: its
leaves count the open rows of that room, and a descent finds the smallest sufficient one in log(WINDOW) steps.

Packing is done within shards of about SHARD_CHARS of text, drawn by a hash of doc_id, one task each: the
tree sees thousands of pieces at once, which leaves best-fit-decreasing nothing to gain from more. A row of
the result is a row of the matrix: ids padded to WINDOW, cumulative segment lengths, and positions that
start again at 0 with each segment. ``write_matrices`` writes them as binary files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm import _bpe
from chunkloom.llm._frames import by_shard, slices
from chunkloom.plans.lineage import cut, small_side

WINDOW = 2048
PAD = _bpe.EOS
SHARD_CHARS = 12 << 20
ROWS = 256  #: rows of a matrix that are handed on at once
SCHEMA = "shard bigint, row bigint, n_tokens int, doc_ids array<bigint>, pieces array<int>, cu_seqlens array<int>, ids array<int>, positions array<int>"


class Rooms:
    """Open rows by their room: a segment tree of counts over 0 .. capacity."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the smallest room of at least ``least`` (the latest put in of equals) and its room."""
        count, i = self.count, least + self.size
        if not count[i]:
            # up to the first ancestor with something to the right, then down its leftmost path
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: np.ndarray, window: int) -> np.ndarray:
    """The row of each piece; pieces of equal size are placed in the order given."""
    rooms, row, n = Rooms(window), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = rooms.take(size) if size < window else None
        if found is None:
            at, room, n = n, window, n + 1
        else:
            at, room = found
        row[i] = at
        if room > size:
            rooms.put(room - size, at)
    return row


def _matrix(shard: int, doc_ids: pa.Array, start: np.ndarray, size: np.ndarray, flat: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """The rows of a shard's matrix, ROWS at a time; document d's ids are ``flat[start[d] : start[d] + size[d]]``."""
    count = -(-size // window)
    of = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start, size = start[of] + number * window, np.minimum(window, size[of] - number * window)
    row = best_fit_decreasing(size, window)
    order = np.argsort(row, kind="stable")  # within a row in the order of documents
    start, size, of, number = start[order], size[order], of[order], number[order].astype(np.int32)
    first = np.concatenate([[0], np.cumsum(np.bincount(row))])
    for a in range(0, len(first) - 1, ROWS):
        heads = first[a : a + ROWS + 1]
        n, part = len(heads) - 1, slice(heads[0], heads[-1])
        segments, heads = np.diff(heads), heads - heads[0]
        length, ends = size[part], np.concatenate([[0], np.cumsum(size[part])])
        used = np.diff(ends[heads])
        inside = ends[:-1] - np.repeat(ends[heads[:-1]], segments)
        step = np.arange(ends[-1]) - np.repeat(ends[:-1], length)
        at = np.repeat(np.repeat(np.arange(n) * window, segments) + inside, length) + step
        out, pos = np.full(n * window, PAD, np.int32), np.zeros(n * window, np.int32)
        out[at], pos[at] = flat[np.repeat(start[part], length) + step], step
        lead = heads[:-1] + np.arange(n)
        bounds = np.zeros(len(length) + n, np.int32)
        is_end = np.ones(len(bounds), bool)
        is_end[lead] = False
        bounds[is_end] = inside + length
        whole = np.arange(n + 1) * window
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, shard)), pa.array(np.arange(a, a + n)), pa.array(used.astype(np.int32)),
                lists(heads, doc_ids.take(pa.array(of[part]))), lists(heads, pa.array(number[part])),
                lists(np.append(lead, len(bounds)), pa.array(bounds)), lists(whole, pa.array(out)), lists(whole, pa.array(pos)),
            ],
            ["shard", "row", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "ids", "positions"],
        )


def packed_ids(docs: DataFrame, window: int = WINDOW, tokenizer: str = _bpe.DEFAULT, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """``(doc_id, text)`` -> the rows of the packed matrices.

    ``pieces`` number a document's pieces; joined in that order and without the end sign they decode to the
    whole text. ``cu_seqlens`` starts with 0 and ends with ``n_tokens``; ids after that are PAD, positions 0.
    Empty texts give their end sign alone, null texts are left out; rows without doc_id are packed under a
    null. Rows that repeat a doc_id are each packed (in the order of their texts' hashes); any number of
    equal rows spread over several shards. Equal sizes are placed in the order of doc_id, nulls last. Texts of
    any length are split losslessly. An empty table gives no rows; other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    d = d.withColumn("h", F.xxhash64("text"))
    # rows and characters of equal rows: one key may hold a third of the table
    same = cut(d.groupBy("doc_id", "h").agg(F.count("*").alias("rows"), F.sum(F.length("text") + 1).alias("chars")))
    chars = same.agg(F.coalesce(F.sum("chars"), F.lit(0))).first()[0]
    shards, key = 1 + chars // shard_chars, [F.col("doc_id"), F.col("h")]
    hot = same.where((F.col("rows") > 1) & (F.col("chars") > shard_chars // 2))
    if n_hot := hot.count():
        parts = hot.select(F.col("doc_id").alias("id_"), F.col("h").alias("h_"), F.floor(1 + 2 * F.col("chars") / shard_chars).alias("parts"))
        d = d.join(small_side(parts, n_hot), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
        key.append(F.coalesce(F.monotonically_increasing_id() % F.col("parts"), F.lit(0)))
    d = d.select("doc_id", "text", F.pmod(F.xxhash64(*key), F.lit(shards)).alias("shard"), "h")

    def encode(batches):
        for part, texts in slices(batches):
            ids = [np.append(_bpe.encode(t, tokenizer), _bpe.EOS).astype(np.int32).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("shard", "doc_id", "h")), pa.array(ids, pa.binary())], ["shard", "doc_id", "h", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, flat = [], [], []
        for batch in batches:
            keys.append(batch.select(["shard", "doc_id", "h"]))
            ids = batch.column("ids").to_pylist()
            sizes += map(len, ids)
            flat.append(np.frombuffer(b"".join(ids), np.int32))
        key, size = pa.Table.from_batches(keys), np.array(sizes, np.int64) // 4
        order = pc.sort_indices(key, [("doc_id", "ascending"), ("h", "ascending")]).to_numpy()
        start = np.cumsum(size) - size
        doc_ids = key.column("doc_id").combine_chunks().take(pa.array(order))
        yield from _matrix(key.column("shard")[0].as_py(), doc_ids, start[order], size[order], np.concatenate(flat), window)

    encoded = d.mapInArrow(encode, "shard bigint, doc_id bigint, h bigint, ids binary")
    return by_shard(encoded, "shard", shards).applyInArrow(pack, SCHEMA)


def write_matrices(packed: DataFrame, folder: str) -> DataFrame:
    """Writes ``ids`` and ``positions`` of each shard as int32 .npy matrices and the segment lengths beside them.

    ``folder`` is one that all executors share (a path or a URI of pyarrow's file systems). Files are written
    under a name of the attempt and then renamed, so a repeated task leaves the same files. Returns the
    manifest (shard, n_rows, n_tokens); nothing is written before it is read.
    """

    def write(table: pa.Table) -> pa.Table:
        import io
        import uuid

        from pyarrow import fs

        table = table.sort_by("row")
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        shard, n = table.column("shard")[0].as_py(), table.num_rows
        arrays = {name: table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(n, -1) for name in ("ids", "positions")}
        cu = table.column("cu_seqlens").combine_chunks()
        arrays |= {"cu_seqlens": cu.flatten().to_numpy(), "cu_offsets": np.concatenate([[0], np.cumsum(cu.value_lengths().to_numpy())])}
        for name, x in arrays.items():
            data = io.BytesIO()
            np.save(data, x)
            part = f"{base}/{name}-{shard:08d}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as f:
                f.write(data.getvalue())
            system.move(part, f"{base}/{name}-{shard:08d}.npy")
        return pa.table({"shard": pa.array([shard]), "n_rows": pa.array([n]), "n_tokens": pa.array([int(sum(table.column("n_tokens").to_pylist()))])})

    return packed.groupBy("shard").applyInArrow(write, "shard bigint, n_rows bigint, n_tokens bigint")


def op8_pack_bfd(spark, sf_dir: str) -> DataFrame:
    return packed_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))

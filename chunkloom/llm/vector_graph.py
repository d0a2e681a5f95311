"""Operator 1: near-duplicate embeddings by a robust-pruned flat graph.

Exact copies collapse first. The distinct vectors are put into overlapping shards (their OVERLAP nearest
centroids); each shard builds a flat proximity graph by batch insertion and robust pruning; the adjacency
lists that a vector has in several shards are united. Every vector is then a query: in each of its shards a
greedy search runs from the medoid over the united lists, and from what it finds within the radius the range
is expanded, neighbour by neighbour, until nothing within the radius is new. Cosines are computed again in
double precision before a pair counts.

Dense groups don't go into the graphs, since one of many shards would scatter its pairs. Where the sample
shows at least half a shard of vectors within the radius of one of them, that one becomes a leader, and all
within its radius are compared with everything that the triangle inequality lets them reach, block by block.
Their pairs are counted but not written; a vector is linked to the leaders whose members it is near to.

The search is audited: AUDIT vectors are compared with all others by brute force, and as long as less than
RECALL of their partners were found, on the mean over the vectors that have any, everything is repeated with
one more shard a vector and twice the beam. After ROUNDS of this the pairs are sought by brute force.

A table's first CELLS centroids are fitted on a sample; a shard that comes out at more than TOO_LARGE times
SHARD is split by centroids of its own, in pieces of CHUNK vectors that meet its centroids as cogroups, so that
shards hold about SHARD vectors whatever the size of the table, and what is broadcast stays below CELLS vectors.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._grams import bounded_sample
from chunkloom.llm._text import mix
from chunkloom.llm.components import connected_components
from chunkloom.plans.lineage import cut, small_side
from chunkloom.plans.skew import named

COSINE = 0.95
SHARD, OVERLAP = 2048, 2
DEGREE, SLACK, BEAM, ALPHA = 24, 2, 8, 1.2  #: a list is pruned to DEGREE when it exceeds SLACK times that
NEAREST, FAR = 48, 16  #: candidates of a node's list: its nearest ones and drawn ones, for edges that lead away
ENTRIES = 4  #: medoids, of the about sqrt(n) of a shard, that a search begins from
BATCH = 256
AUDIT, RECALL, ROUNDS = 512, 0.95, 4
SAMPLE = 16384  #: vectors that the centroids are fitted on, at most
CELLS, TOO_LARGE, SPLITS, CHUNK = 16384, 4, 4, 65536
BRUTE = 1 << 22  #: vectors up to which pairs are sought by brute force where the audit fails; beyond, it is an error
BLOCK_BYTES, TILE = 32 << 20, 1 << 20  #: vectors broadcast at once for comparisons with all; cosines held at once

log = logging.getLogger(__name__)


def centroids(x: np.ndarray, k: int, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of the rows of x; an empty cluster takes a row of the largest one."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        of = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        n = np.bincount(of, minlength=k)
        order = np.argsort(of, kind="stable")
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = n > 0
        c[full] = np.add.reduceat(x[order], first[full], axis=0)
        for j in np.flatnonzero(~full):
            c[j] = x[rng.choice(np.flatnonzero(of == n.argmax()))]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


class Graph:
    """``x``: unit vectors; ``out``: (n, DEGREE or more) neighbours, -1 where there is none; ``medoids``: where searches begin."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        c = centroids(self.x, int(len(x) ** 0.5) + 1, rounds=3)
        self.medoids = np.unique(np.concatenate([(self.x @ c[a : a + 64].T).argmax(0) for a in range(0, len(c), 64)]))
        self.out = np.full((len(x), SLACK * DEGREE), -1, np.int32)

    def greedy(self, queries: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Beams (ids, distances) of greedy searches from the nearest medoids, and all the nodes that each expanded, in steps.

        ``own``: the queries' own nodes where they have lists already; each search then begins from its node too.
        """
        b, rows = len(queries), np.arange(len(queries))
        ids, dist = np.full((b, beam), -1, np.int32), np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)
        k = min(ENTRIES, beam, len(self.medoids))
        far = 1 - queries @ self.x[self.medoids].T
        best = np.argsort(far, axis=1, kind="stable")[:, :k]
        ids[:, :k], dist[:, :k], done[:, :k] = self.medoids[best], np.take_along_axis(far, best, 1), False
        seen = np.zeros((b, len(self.x)), bool)
        if own is not None and k < beam:
            new = (ids[:, :k] != own[:, None]).all(1)
            ids[new, k], dist[new, k], done[new, k] = own[new], 0, False
        seen[rows[:, None], np.maximum(ids[:, : k + 1], ids[:, :1])] = True
        went, went_d = [], []
        live = rows
        while len(live):
            at = np.argmin(done[live], axis=1)
            cur = ids[live, at]
            done[live, at] = True
            step, step_d = np.full(b, -1, np.int32), np.full(b, np.inf, np.float32)
            step[live], step_d[live] = cur, dist[live, at]
            went.append(step)
            went_d.append(step_d)
            near = self.out[cur]
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            d = np.full(near.shape, np.inf, np.float32)
            d[r, c] = 1 - np.einsum("ij,ij->i", queries[live[r]], self.x[near[r, c]])
            all_d = np.concatenate([dist[live], d], 1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[live] = np.take_along_axis(all_d, order, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], near], 1), order, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], 1), order, 1)
            live = live[~done[live].all(1)]
        return ids, dist, np.stack(went, 1), np.stack(went_d, 1)

    def prune(self, nodes: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Robust pruning: the nearest candidate stays and takes out all that are ALPHA times nearer to it than to the node."""
        b = len(nodes)
        dist = np.where((cand < 0) | (cand == nodes[:, None]), np.inf, dist)
        order = np.argsort(dist, axis=1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        v = self.x[np.maximum(cand, 0)]
        between = 1 - v @ v.transpose(0, 2, 1)
        out, rows, dist = np.full((b, DEGREE), -1, np.int32), np.arange(b), dist.copy()
        for k in range(DEGREE):
            best = dist.argmin(1)
            some = np.isfinite(dist[rows, best])
            if not some.any():
                break
            out[some, k] = cand[rows, best][some]
            gone = ALPHA**2 * between[rows, best] <= dist
            gone[rows, best] = True
            dist[gone & some[:, None]] = np.inf
        return out

    def build(self, seed: int = 5) -> Graph:
        """Robust-prunes for each node its NEAREST nearest ones in the shard and FAR drawn ones, then links back.

        A shard is small enough for all its distances to be taken at once, in blocks of rows.
        """
        n, rng = len(self.x), np.random.default_rng(seed)
        near = min(NEAREST, n)
        for at in range(0, n, BATCH):
            nodes = np.arange(at, min(at + BATCH, n))
            d = 1 - self.x[nodes] @ self.x.T
            cand = np.argpartition(d, near - 1, axis=1)[:, :near] if near < n else np.tile(np.arange(n), (len(nodes), 1))
            far = rng.integers(0, n, (len(nodes), FAR))
            cand = np.sort(np.concatenate([cand, far], 1), axis=1).astype(np.int32)
            dist = np.take_along_axis(d, cand, 1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            self.out[nodes, :DEGREE] = self.prune(nodes, cand, dist)
        for at in range(0, n, BATCH):
            self._reverse(np.arange(at, min(at + BATCH, n)))
        return self

    def _reverse(self, nodes: np.ndarray) -> None:
        src = np.repeat(nodes, DEGREE).astype(np.int32)
        dst = self.out[nodes, :DEGREE].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        new = ~(self.out[dst] == src[:, None]).any(1)
        src, dst = src[new], dst[new]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        have = (self.out[targets] >= 0).sum(1)
        most = self.out.shape[1]
        width = int(max((have + count).max(initial=0), most))
        wide = np.full((len(targets), width), -1, np.int32)
        wide[:, :most] = self.out[targets]
        row = np.repeat(np.arange(len(targets)), count)
        wide[row, have[row] + np.arange(len(src)) - np.repeat(first, count)] = src
        over = have + count > most
        self.out[targets[~over]] = wide[~over, :most]
        for a in range(0, int(over.sum()), BATCH):
            k = np.flatnonzero(over)[a : a + BATCH]
            d = 1 - np.einsum("ijk,ik->ij", self.x[np.maximum(wide[k], 0)], self.x[targets[k]])
            self.out[targets[k], :DEGREE] = self.prune(targets[k], wide[k], d)
            self.out[targets[k], DEGREE:] = -1

    def within(self, radius: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, other) of nodes within the radius: greedy search of every node, then expansion of the range.

        The expansion follows edges both ways: pruning leaves tight groups few edges, and those directed.
        """
        a, b = [], []
        src, dst = np.repeat(np.arange(len(self.x)), self.out.shape[1]), self.out.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        both = np.concatenate([src, dst])
        order = np.argsort(both, kind="stable")
        ends = np.concatenate([dst, src])[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(both, minlength=len(self.x)))])
        for at in range(0, len(self.x), BATCH):
            nodes = np.arange(at, min(at + BATCH, len(self.x)))
            ids, dist, went, went_d = self.greedy(self.x[nodes], beam, nodes)
            ids, dist = np.concatenate([ids, went, nodes[:, None]], 1), np.concatenate([dist, went_d, np.zeros((len(nodes), 1), np.float32)], 1)
            seen = np.zeros((len(nodes), len(self.x)), bool)
            q, k = np.nonzero((dist <= radius) & (ids >= 0))
            front = np.unique(q * np.int64(len(self.x)) + ids[q, k])
            while len(front):  # the queries' ranges grow together, a step along the edges at a time
                q, k = np.divmod(front, len(self.x))
                seen[q, k] = True
                size = first[k + 1] - first[k]
                other = ends[np.repeat(first[k] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                q = np.repeat(q, size)
                new = np.zeros_like(seen)
                new[q, other] = True
                q, other = np.nonzero(new & ~seen)
                inside = 1 - np.einsum("ij,ij->i", self.x[nodes[q]], self.x[other]) <= radius
                front = q[inside] * np.int64(len(self.x)) + other[inside]
            seen[np.arange(len(nodes)), nodes] = False
            q, k = np.nonzero(seen)
            a.append(nodes[q])
            b.append(k)
        return np.concatenate([np.zeros(0, np.int64), *a]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *b]).astype(np.int64)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    ids = table.column("id").to_numpy()
    g = Graph(_unit(_matrix(table.column("v")))).build()
    have = g.out >= 0
    return pa.table({"id": table.column("id"), "out": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(have.sum(1))]), pa.int32()), pa.array(ids[g.out[have]], pa.int64()))})


def _search(cosine: float, beam: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, x = table.column("id").to_numpy(), _unit(_matrix(table.column("v")))
        g = Graph(x)
        lists = table.column("out").combine_chunks()
        n = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        at = np.where(ids[at] == flat, at, -1)  # a neighbour that isn't in this shard
        wide = np.full((len(ids), max(1, int(n.max(initial=1)))), -1, np.int32)
        row = np.repeat(np.arange(len(ids)), n)
        wide[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = at
        g.out = wide
        a, b = g.within(1 - cosine + 1e-6, beam)
        sim = np.einsum("ij,ij->i", x[a], x[b])
        keep = sim >= cosine
        lo, hi = np.minimum(ids[a], ids[b])[keep], np.maximum(ids[a], ids[b])[keep]
        return pa.table({"a": lo, "b": hi, "cosine": sim[keep]}).group_by(["a", "b"]).aggregate([("cosine", "max")]).rename_columns(["a", "b", "cosine"])

    return run


def _assign(v: DataFrame, c: np.ndarray, overlap: int) -> DataFrame:
    """``(id, v)`` -> ``(shard, id, v)``: a row for each of the nearest centroids."""
    shared = v.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        k = min(overlap, len(shared.value))
        for batch in batches:
            s = _unit(_matrix(batch.column(1))) @ shared.value.T
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            row = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_arrays([pa.array(best.ravel()), batch.column(0).take(row), batch.column(1).take(row)], ["shard", "id", "v"])

    return v.mapInArrow(run, "shard bigint, id bigint, v array<float>")


def _members(v: DataFrame, c: np.ndarray, overlap: int, shard: int) -> DataFrame:
    """``(shard, id, v)`` with each vector in at least ``overlap`` shards, none of much more than ``shard`` vectors as far as centroids can tell them apart."""
    done, rest = None, cut(_assign(v, c, overlap))
    for _ in range(SPLITS):
        sizes = cut(rest.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > TOO_LARGE * shard))
        if not (n_large := sizes.count()):
            break
        fits = rest.join(small_side(sizes.select("shard"), n_large), "shard", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        rest = cut(_split(rest.join(small_side(sizes, n_large), "shard"), sizes, overlap, shard))
    return rest if done is None else cut(done.unionByName(rest))


def _split(large: DataFrame, sizes: DataFrame, overlap: int, shard: int) -> DataFrame:
    """Members ``(shard, id, v, n)`` of too large shards -> ``(shard, id, v)`` by the nearest of each shard's own centroids."""
    wanted = F.ceil(F.col("n") / F.lit(shard))  # centroids, and four sampled vectors for each
    picked = large.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < 4 * wanted / F.col("n") * F.lit(1 << 20))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = _unit(_matrix(table.column("v")))
        c = centroids(x, max(2, -(-table.column("n")[0].as_py() // shard)))
        return pa.table({"shard": table.column("shard").slice(0, 1), "c": pa.array([c.astype(np.float32).tobytes()], pa.binary())})

    own = picked.select("shard", "id", "v", "n").groupBy("shard").applyInArrow(fit, "shard bigint, c binary")
    parts = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
    own = own.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "c")
    pieces = large.select("shard", F.pmod(F.xxhash64("id", F.lit(12)), parts).cast("int").alias("part"), "id", "v")

    def assign(key, table: pa.Table, of: pa.Table) -> pa.Table:
        x = _unit(_matrix(table.column("v")))
        if not of.num_rows:  # none of its vectors was drawn
            return table.select(["shard", "id", "v"])
        c = np.frombuffer(of.column("c")[0].as_py(), np.float32).reshape(-1, x.shape[1]).astype(np.float64)
        k = min(overlap, len(c))
        best = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :k]
        rows = pa.array(np.repeat(np.arange(len(x)), k))
        # a number of its own: the old one and the centroid's, mixed
        number = mix(best.ravel().astype(np.uint64) + np.uint64(1) + mix(np.array([key[0].as_py()], np.int64).view(np.uint64)))
        return pa.table({"shard": pa.array(number.view(np.int64)), "id": table.column("id").take(rows), "v": table.column("v").take(rows)})

    split = pieces.groupBy("shard", "part").cogroup(own.groupBy("shard", "part")).applyInArrow(assign, "shard bigint, id bigint, v array<float>")
    return split.dropDuplicates(["shard", "id"])


def _brute(v: DataFrame, queries: tuple[np.ndarray, np.ndarray], cosine: float, once: bool = False) -> DataFrame:
    """Pairs of the queries with all of ``v``; with ``once`` only those whose query has the smaller id."""
    shared = v.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        q_ids, q = shared.value[0], _unit(shared.value[1].astype(np.float64))
        step = max(1, TILE // max(1, len(q_ids)))
        for batch in batches:
            x, all_ids = _unit(_matrix(batch.column(1))), batch.column(0).to_numpy()
            for at in range(0, len(x), step):
                s = x[at : at + step] @ q.T
                r, c = np.nonzero(s >= cosine)
                ids, sim = all_ids[at + r], s[r, c]
                keep = ids > q_ids[c] if once else ids != q_ids[c]
                lo, hi = np.minimum(ids, q_ids[c])[keep], np.maximum(ids, q_ids[c])[keep]
                yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi), pa.array(sim[keep])], ["a", "b", "cosine"])

    return v.mapInArrow(run, "a bigint, b bigint, cosine double")


def _blocks(v: DataFrame, n: int, dim: int):
    """The ``n`` rows of ``v`` on the driver, in tables of about BLOCK_BYTES."""
    parts = max(1, -(-n * dim * 4 // BLOCK_BYTES))
    for k in range(parts):
        yield v.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)) == k).toArrow()


def all_pairs(v: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``near_pairs`` by brute force."""
    n, dim = v.count(), v.select(F.size("v")).first()[0]
    found = None
    for t in _blocks(v.select("id", "v"), n, dim):
        if t.num_rows:
            pairs = cut(_brute(v, (t.column("id").to_numpy(), _matrix(t.column("v")).astype(np.float32)), cosine, True))
            found = pairs if found is None else found.unionByName(pairs)
    return found


def _recall(true: DataFrame, found: DataFrame, audited: DataFrame) -> float:
    """The share of its partners that an audited vector was given, on the mean over those that have any."""
    hit = true.join(found.select("a", "b", F.lit(1.0).alias("hit")), ["a", "b"], "left")
    each = hit.select(F.explode(F.array("a", "b")).alias("id"), F.coalesce("hit", F.lit(0.0)).alias("hit")).join(F.broadcast(audited), "id")
    mean = each.groupBy("id").agg(F.avg("hit").alias("r")).agg(F.avg("r")).first()[0]
    return 1.0 if mean is None else mean


def near_pairs(v: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """``(id, v)`` of distinct finite vectors of one length -> ``(a, b, cosine)`` with a < b, each pair once."""
    spark = v.sparkSession
    n = v.count()
    dim = v.select(F.size("v")).first()
    if n < 2:
        return spark.createDataFrame([], "a bigint, b bigint, cosine double")
    sample = bounded_sample(v, "id", SAMPLE).orderBy("id").toPandas()
    x = _unit(np.stack(sample["v"]).astype(np.float64))
    c = centroids(x, min(CELLS, -(-n // shard), max(1, len(x) // 4)))
    few = bounded_sample(v, "id", AUDIT, 1).orderBy("id").toPandas()
    q = few["id"].to_numpy(np.int64), np.stack(few["v"]).astype(np.float32)
    true = cut(_brute(v, q, cosine).select("a", "b").distinct())
    audited = spark.createDataFrame([(int(i),) for i in q[0]], "id bigint")
    overlap, beam = OVERLAP, BEAM
    for _ in range(ROUNDS):
        members = _members(v, c, overlap, shard)
        lists = members.groupBy("shard").applyInArrow(_build, "id bigint, out array<bigint>")
        lists = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("out"))).alias("out"))
        found = members.join(lists, "id").select("shard", "id", "v", "out").groupBy("shard").applyInArrow(_search(cosine, beam), "a bigint, b bigint, cosine double")
        found = cut(found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")))
        recall = _recall(true, found, audited)
        if recall >= RECALL:
            log.info("graph search found %.4f of the audited partners", recall)
            return found
        log.warning("graph search found %.3f of the audited partners with %d shards a vector and beam %d", recall, overlap, beam)
        overlap, beam = overlap + 1, 2 * beam
    if n > BRUTE:
        raise RuntimeError(f"graph search found {recall:.3f} of the audited partners, less than {RECALL}, and {n} vectors are too many for brute force")
    log.warning("graph search stays below %.2f: %d vectors are compared by brute force", RECALL, n)
    return all_pairs(v, cosine)


def leaders(x: np.ndarray, n: int, cosine: float, dense: int) -> np.ndarray:
    """Rows of the unit vectors x, a sample of n, near which about ``dense`` of the n lie; none near another one."""
    y = x.astype(np.float32)
    count = np.concatenate([(y[a : a + 512] @ y.T >= cosine).sum(1) for a in range(0, len(y), 512)])
    left = np.flatnonzero(count >= max(3, dense * len(x) / n))
    left, out = left[np.argsort(-count[left], kind="stable")], []
    while len(left):
        out.append(left[0])
        left = left[1:][x[left[1:]] @ x[left[0]] < cosine]
    return np.array(out, np.int64)


def _home(v: DataFrame, lead: np.ndarray, cosine: float) -> DataFrame:
    """``(id, v, w)`` and the nearest leader within the cosine, -1 where there is none."""
    shared = v.sparkSession.sparkContext.broadcast(lead)

    def run(batches):
        for batch in batches:
            s = _unit(_matrix(batch.column(1))) @ shared.value.T
            home = np.where(s.max(1) >= cosine, s.argmax(1), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], ["id", "v", "w", "home"])

    return v.mapInArrow(run, "id bigint, v array<float>, w bigint, home bigint")


def _against(v: DataFrame, block: pa.Table, lead: np.ndarray, lead_ids: np.ndarray, cosine: float) -> DataFrame:
    """All of ``v`` against a block of members: ``near`` counts to be added up, and leaders of members that are near."""
    block = block.sort_by("home")
    q = _matrix(block.column("v")).astype(np.float32)
    shared = v.sparkSession.sparkContext.broadcast((q, *(block.column(k).to_numpy() for k in ("id", "w", "home")), lead, lead_ids))
    # two radii from the leader: no member is near to what lies beyond
    reach = np.cos(min(np.pi, 2 * np.arccos(np.clip(cosine, -1, 1)))) - 1e-9

    def rows(ids, near, leader=None):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.int64()), pa.array(leader, pa.int64()) if leader is not None else pa.nulls(len(ids), pa.int64())], ["id", "near", "leader"])

    def run(batches):
        q, ids, w, home, lead, lead_ids = shared.value
        q, w, total = _unit(q.astype(np.float64)), w.astype(np.float64), np.zeros(len(ids))
        first = np.searchsorted(home, np.arange(len(lead) + 1))
        for batch in batches:
            x, x_ids, x_w = _unit(_matrix(batch.column(1))), batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.float64)
            to_lead, own = x @ lead.T, np.zeros(len(x))
            for k in np.flatnonzero(np.diff(first)):
                a, b = first[k], first[k + 1]
                reached = np.flatnonzero(to_lead[:, k] >= reach)
                step = max(1, TILE // (b - a))
                for at in range(0, len(reached), step):
                    r = reached[at : at + step]
                    hit = ((x[r] @ q[a:b].T >= cosine) & (x_ids[r][:, None] != ids[a:b])).astype(np.float64)
                    total[a:b] += x_w[r] @ hit
                    own[r] += hit @ w[a:b]
                    linked = x_ids[r][hit.any(1)]
                    yield rows(linked, np.zeros(len(linked), np.int64), np.full(len(linked), lead_ids[k]))
            lone = (batch.column(3).to_numpy() < 0) & (own > 0)  # members are counted from their own side
            yield rows(x_ids[lone], own[lone].astype(np.int64))
        yield rows(ids[total > 0], total[total > 0].astype(np.int64))

    return v.mapInArrow(run, "id bigint, near bigint, leader bigint")


def dense_groups(v: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """``(id, v, w)`` -> the vectors of no dense group, and of the pairs with a member of one: ``(id, near)`` by weight w, and ``(a, b)`` links."""
    n, dense = v.count(), max(2, shard // 2)
    if n < dense:
        return v, None, None
    sample = bounded_sample(v.select("id", "v"), "id", SAMPLE).orderBy("id").toPandas()
    if not len(sample):
        return v, None, None
    x = _unit(np.stack(sample["v"]).astype(np.float64))
    at = leaders(x, n, cosine, dense)
    if not len(at):
        return v, None, None
    lead, lead_ids = x[at], sample["id"].to_numpy(np.int64)[at]
    v = cut(_home(v.select("id", "v", "w"), lead, cosine))
    members = v.where("home >= 0")
    met = None
    for block in _blocks(members, members.count(), x.shape[1]):
        if block.num_rows:
            got = cut(_against(v, block, lead, lead_ids, cosine))
            met = got if met is None else met.unionByName(got)
    own = v.sparkSession.createDataFrame(list(enumerate(lead_ids.tolist())), "home bigint, leader bigint")
    stars = members.join(F.broadcast(own), "home").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    links = met.where("leader is not null").select(F.col("id").alias("a"), F.col("leader").alias("b")).union(stars)
    return v.where("home < 0"), met.groupBy("id").agg(F.sum("near").alias("near")), links.where("a <> b").distinct()


def near_duplicate_vectors(embeddings: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """``(vec_id, embedding)`` -> ``(vec_id, group_id, is_kept, n_near)``, a row for each distinct vec_id that isn't null.

    ``group_id`` is the smallest vec_id of those linked by cosines of at least ``cosine``, directly or over
    others; it alone is kept. ``n_near`` counts the other vec_ids within the cosine, exact copies included.
    Null, empty and zero vectors, those with a null, NaN or infinite part, and those of another length than
    most have no neighbours. Of rows that repeat a vec_id the vector of the smallest hash counts. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    e = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("v")).where("id is not null")
    e = cut(e.groupBy("id").agg(F.min_by("v", F.coalesce(F.xxhash64("v"), F.lit(0))).alias("v")))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3e38)) & F.exists("v", lambda x: F.abs(x) > 1e-20)
    size = e.where(good).groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    ok = F.coalesce(good & (F.size("v") == F.lit(size[0] if size else 0)), F.lit(False))
    # equal vectors are known by 128 bits of hash; +0 makes one of both zeros
    plain = F.transform("v", lambda x: x + F.lit(0).cast("float"))
    good_ = e.where(ok).select("id", "v", F.xxhash64(plain).alias("h1"), F.xxhash64(plain, F.lit(1)).alias("h2"))
    copies = cut(good_.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    exact = cut(good_.select("id", "v").join(copies.select(F.col("rep").alias("id"), F.col("copies").alias("w")), "id"))
    rest, near_dense, links = dense_groups(exact, cosine, shard)
    pairs = near_pairs(rest.select("id", "v"), cosine, shard)
    sides = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    times = exact.select(F.col("id").alias("other"), F.col("w").alias("near"))
    near = sides.join(times, "other").select("rep", "near")
    edges = pairs.select("a", "b")
    if links is not None:
        near, edges = near.union(near_dense.select("id", "near")), edges.union(links)
    near = near.groupBy("rep").agg(F.sum("near").alias("near"))
    groups = connected_components(edges).withColumnRenamed("id", "rep")
    each = exact.select(F.col("id").alias("rep"), "w").join(near, "rep", "left").join(groups, "rep", "left")
    each = each.select("rep", F.coalesce("component", "rep").alias("group_id"), (F.coalesce("near", F.lit(0)) + F.col("w") - 1).alias("n_near"))
    out = named(good_.select("id", "h1", "h2"), copies, "id", ["h1", "h2"]).join(each, "rep").select(F.col("id").alias("vec_id"), "group_id", "n_near")
    lone = e.where(~ok).select(F.col("id").alias("vec_id"), F.col("id").alias("group_id"), F.lit(0).cast("bigint").alias("n_near"))
    return out.unionByName(lone).select("vec_id", "group_id", (F.col("vec_id") == F.col("group_id")).alias("is_kept"), "n_near")


def op1_vector_graph(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS g FROM v UNION SELECT p.b, r.g FROM r JOIN p ON p.a = r.id)
SELECT r.id AS vec_id, min(g) AS group_id, r.id = min(g) AS is_kept, (SELECT count(*) FROM p WHERE p.a = r.id) AS n_near FROM r GROUP BY r.id
"""

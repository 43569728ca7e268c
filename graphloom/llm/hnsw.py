"""Approximate nearest neighbours: a navigable small-world graph per shard, shard results merged.

Vectors are dealt to shards by a hash of their id.  Each shard builds a hierarchical graph whose layers
are flat int32 neighbour arrays (rows of fixed width, padded with -1), inserting in batches that double
up to a bound, each batch searched in the graph so far and against itself.  Queries are sent to every shard
and stream past its graph in the task that built it, walking in lockstep with numpy; the best k of all
shards are kept.  The distance is the cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import text as tx
from graphloom.llm.common import integer

K, M, EF_BUILD, EF_SEARCH = 10, 16, 64, 96
#: Vectors a shard holds, and queries that walk together.
SHARD_ROWS, BLOCK = 10_000, 1024
BATCH = 512


class Graph:
    """nodes[l]: ids of layer l in rising order; links[l]: (len(nodes[l]), width) neighbours, -1 for none."""

    def __init__(self, vectors: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray], entry: int):
        self.vectors, self.nodes, self.links, self.entry = vectors, nodes, links, entry

    # layer 0 holds all nodes, so its rows are the node numbers
    def rows(self, layer: int, ids: np.ndarray) -> np.ndarray:
        return ids if layer == 0 else np.searchsorted(self.nodes[layer], ids)

    def walk(self, queries: np.ndarray, start: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The `ef` nearest nodes of a layer found from the start nodes (a column or more): ids (-1: none) and distances."""
        n, most = len(queries), len(self.vectors)
        ids = np.full((n, ef), -1, np.int32)
        far = np.full((n, ef), np.inf, np.float32)
        width = min(ef, start.shape[1])
        ids[:, :width] = start[:, :width]
        d = 1 - np.einsum("qd,qkd->qk", queries, self.vectors[np.maximum(ids[:, :width], 0)])
        far[:, :width] = np.where(ids[:, :width] >= 0, d, np.inf)
        order = np.argsort(far, axis=1)
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        open_ = far < np.inf
        seen = np.zeros((n, most + 1), bool)
        seen[np.arange(n)[:, None], ids] = True
        active = np.arange(n)
        links = self.links[layer]
        while len(active):
            left = open_[active]
            go = left.any(axis=1)
            active, left = active[go], left[go]
            if not len(active):
                break
            at = left.argmax(axis=1)  # the beam is sorted: the first open one is the nearest
            open_[active, at] = False
            near = links[self.rows(layer, ids[active, at])]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            seen[active[:, None], near] |= fresh
            d = 1 - np.einsum("qd,qkd->qk", queries[active], self.vectors[np.maximum(near, 0)])
            d = np.where(fresh, d, np.inf)
            hit = d.min(axis=1) < far[active, -1]
            if not hit.any():
                continue
            a, near, d = active[hit], near[hit], d[hit]
            all_d = np.concatenate([far[a], d], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
            far[a] = np.take_along_axis(all_d, order, 1)
            ids[a] = np.take_along_axis(np.concatenate([ids[a], near], axis=1), order, 1)
            open_[a] = np.take_along_axis(np.concatenate([open_[a], d < np.inf], axis=1), order, 1) & (far[a] < np.inf)
        ids[far == np.inf] = -1
        return ids, far

    def search(self, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest found for each query: ids (-1: none) and distances, nearest first."""
        at = np.full((len(queries), 1), self.entry, np.int32)
        for layer in range(len(self.links) - 1, 0, -1):
            at, _ = self.walk(queries, at, layer, 1)
        ids, d = self.walk(queries, at, 0, max(ef, k))
        return ids[:, :k], d[:, :k]

    def pack(self) -> dict[str, bytes]:
        return {"vectors": self.vectors.tobytes(), "nodes": np.concatenate([np.array([len(x) for x in self.nodes], np.int32), *self.nodes]).astype(np.int32).tobytes(), "links": np.concatenate([x.reshape(-1) for x in self.links]).astype(np.int32).tobytes(), "shape": np.array([len(self.nodes), self.vectors.shape[1], self.entry, *(x.shape[1] for x in self.links)], np.int32).tobytes()}

    @classmethod
    def unpack(cls, vectors, nodes, links, shape) -> Graph:
        layers, dim, entry, *width = np.frombuffer(shape, np.int32).tolist()
        raw, flat = np.frombuffer(nodes, np.int32), np.frombuffer(links, np.int32)
        sizes, at, to, own, near = raw[:layers].tolist(), layers, 0, [], []
        for n, w in zip(sizes, width):
            own.append(raw[at : at + n])
            near.append(flat[to : to + n * w].reshape(n, w))
            at, to = at + n, to + n * w
        return cls(np.frombuffer(vectors, np.float32).reshape(-1, dim), own, near, entry)


def _choose(vectors: np.ndarray, ids: np.ndarray, d: np.ndarray, m: int) -> np.ndarray:
    """Of candidates sorted by distance, m at most: those nearer to the node than to one chosen before; then the nearest others."""
    n, width = ids.shape
    out = np.full((n, m), -1, np.int32)
    for a in range(0, n, 256):
        own, far = ids[a : a + 256], d[a : a + 256]
        v = vectors[np.maximum(own, 0)]
        between = 1 - v @ v.transpose(0, 2, 1)
        kept = np.zeros(own.shape, bool)
        closest = np.full(own.shape, np.inf, np.float32)  # of each candidate to the chosen
        count = np.zeros(len(own), np.int64)
        for j in range(width):
            good = (own[:, j] >= 0) & (far[:, j] < closest[:, j]) & (count < m)
            kept[:, j] = good
            count += good
            closest = np.where(good[:, None], np.minimum(closest, between[:, :, j]), closest)
        rank = np.where(kept, 0, 1) * width + np.arange(width)
        rank[own < 0] = 3 * width
        order = np.argsort(rank, axis=1)[:, :m]
        chosen = np.take_along_axis(own, order, 1)
        out[a : a + 256, : chosen.shape[1]] = chosen
    return out


def build(vectors: np.ndarray, m: int = M, ef: int = EF_BUILD) -> Graph:
    """The graph of unit vectors; levels come from a hash of the row number, so it is the same every time."""
    vectors = np.ascontiguousarray(vectors, np.float32)
    n = len(vectors)
    chance = (tx.mix(np.arange(n, dtype=np.uint64) + np.uint64(1)) >> np.uint64(11)) / float(1 << 53)
    level = np.minimum((-np.log(np.maximum(chance, 1e-18)) / np.log(m)).astype(int), 5)
    if n:
        level[0] = level.max()
    top = int(level.max(initial=0))
    nodes = [np.flatnonzero(level >= i).astype(np.int32) for i in range(top + 1)]
    links = [np.full((len(x), 2 * m if i == 0 else m), -1, np.int32) for i, x in enumerate(nodes)]
    g = Graph(vectors, nodes, links, 0)
    done = min(n, 1)
    while done < n:
        # new nodes in the order of their numbers, at most as many as there are
        new = np.arange(done, min(n, done + min(done, BATCH)), dtype=np.int32)
        q = vectors[new]
        at = np.zeros((len(new), 1), np.int32)
        inner = 1 - q @ q.T
        np.fill_diagonal(inner, np.inf)
        for layer in range(top, -1, -1):
            mine = np.flatnonzero(level[new] >= layer)
            if not len(mine):
                at, _ = g.walk(q, at, layer, 1)
                continue
            found, d = g.walk(q, at, layer, ef)
            at = found[:, :ef]
            among = inner[np.ix_(mine, mine)]
            near = np.argsort(among, axis=1)[:, : 2 * m]
            ids = np.concatenate([found[mine], new[mine][near]], axis=1)
            far = np.concatenate([d[mine], np.take_along_axis(among, near, 1)], axis=1).astype(np.float32)
            ids[far == np.inf] = -1
            order = np.argsort(far, axis=1, kind="stable")[:, :ef]
            ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
            chosen = _choose(vectors, ids, far, m)
            g.links[layer][g.rows(layer, new[mine]), :m] = chosen
            _back(g, layer, np.repeat(new[mine], m), chosen.reshape(-1))
        done += len(new)
    return g


def _back(g: Graph, layer: int, source: np.ndarray, target: np.ndarray) -> None:
    """Adds source to the neighbours of target for each link, pruning rows that get too long."""
    there = target >= 0
    order = np.argsort(target[there], kind="stable")
    target, source = target[there][order], source[there][order]
    own, first, count = np.unique(target, return_index=True, return_counts=True)
    if not len(own):
        return
    rows = g.rows(layer, own)
    width = g.links[layer].shape[1]
    extra = np.full((len(own), int(count.max())), -1, np.int32)
    extra[np.repeat(np.arange(len(own)), count), np.arange(len(target)) - np.repeat(first, count)] = source
    ids = np.concatenate([g.links[layer][rows], extra], axis=1)
    ids[:, width:][(extra[:, :, None] == g.links[layer][rows][:, None, :]).any(axis=2)] = -1
    d = np.empty(ids.shape, np.float32)
    for a in range(0, len(own), 512):
        d[a : a + 512] = 1 - np.einsum("qd,qkd->qk", g.vectors[own[a : a + 512]], g.vectors[np.maximum(ids[a : a + 512], 0)])
    d[ids < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
    full = (ids >= 0).sum(axis=1) > width
    g.links[layer][rows[~full]] = ids[~full][:, :width]
    if full.any():
        most = int((ids[full] >= 0).sum(axis=1).max())
        g.links[layer][rows[full]] = _choose(g.vectors, ids[full][:, :most], d[full][:, :most], width)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of a list column of equal lengths."""
    v = np.asarray(column.flatten(), np.float32).reshape(-1, dim)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int, int]:
    """(id, v) of the vectors that can be compared, their dimension, the most frequent one, and how many have it.

    Left out: rows without an id or a vector, other dimensions, vectors with a null or non-finite
    component and zero vectors.  Rows that repeat an id are still all there.
    """
    v = vectors.select(integer(F.col(id_col)).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where("id is not null and size(v) > 0")
    dim = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dim is None:
        return v, 0, 0
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return v.where((F.size("v") == dim[0]) & total.isNotNull() & ~F.isnan(total) & (total > 1e-30) & (total < 1e30)), dim[0], dim[1]


def _shards(batches, dim: int, k: int, ef: int):
    """Candidates of rows (shard, asked, id, v) that come shard by shard, the stored vectors before the queries.

    A shard's vectors are gathered (a bounded number), its graph is built at the first query and the
    queries then stream past it, so neither graph nor queries are ever held or sent anywhere as a whole.
    """
    shard, stored, graph, names = None, [], None, None

    for batch in batches:
        at = np.asarray(batch.column(0))
        asked = np.asarray(batch.column(1))
        cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(asked) != 0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if at[a] != shard:
                shard, stored, graph = at[a], [], None
            part = batch.slice(a, b - a)
            if not asked[a]:
                stored.append((np.asarray(part.column(2)), _matrix(part.column(3), dim)))
                continue
            if graph is None:
                if not stored:
                    continue
                names, v = (np.concatenate(x) for x in zip(*stored))
                # of rows that repeat an id the first in order, the least vector, counts
                first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
                names, stored = names[first], [()]
                graph = build(v[first])
            for c in range(0, b - a, BLOCK):
                who, q = np.asarray(part.column(2).slice(c, BLOCK)), _matrix(part.column(3).slice(c, BLOCK), dim)
                near, d = graph.search(q, k + 1, max(ef, k + 1))
                row, col = np.nonzero((near >= 0) & (names[np.maximum(near, 0)] != who[:, None]))
                yield pa.RecordBatch.from_arrays([pa.array(who[row]), pa.array(names[near[row, col]]), pa.array(np.round(1 - d[row, col].astype(np.float64), 6))], ["id", "neighbour", "similarity"])


def nearest_neighbours(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH, queries: Column | None = None) -> DataFrame:
    """(id, rank, neighbour, similarity): up to k nearest others of every usable vector, or of those that fulfil `queries`.

    `queries` is a condition on id; every vector is indexed whatever it says.  Similarities are cosines rounded
    to six places; ranks begin with 1 and go by the rounded similarity, ties by the neighbour's id.  Of rows
    that repeat an id the least vector counts.  See `usable` for what is left out.  A single vector has no
    neighbours; an empty table gives an empty one; other columns are ignored.
    """
    spark = vectors.sparkSession
    good, dim, n = usable(vectors, id_col, vector_col)
    if not dim:
        return spark.createDataFrame([], "id long, rank int, neighbour long, similarity double")
    shards = max(1, -(-n // shard_rows))
    stored = good.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asked"), "id", "v")
    asked = (good if queries is None else good.where(queries)).groupBy("id").agg(F.min("v").alias("v"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asked"), "id", "v")
    rows = stored.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "asked", "id", "v")
    found = rows.mapInArrow(lambda batches: _shards(batches, dim, k, ef), "id long, neighbour long, similarity double")
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "rank", "neighbour", "similarity")


def exact_neighbours(vectors: np.ndarray, k: int) -> np.ndarray:
    """Brute force, for tests."""
    v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]

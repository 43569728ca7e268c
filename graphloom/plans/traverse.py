"""Reachability; distances are shortest hops.

Up to `packed.IN_TASK` edges are walked in one task over integer arrays, more by frontier joins; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.plans import packed
from graphloom.plans.session import cut


#: Layers of found nodes up to which each is kept in its own checkpoint; beyond, they are put together.
LAYERS = 8
#: Tasks for each core that share the components of a graph.
BLOCKS_A_CORE = 4


def coded(edges: DataFrame, *more: DataFrame) -> tuple[DataFrame, ...] | None:
    """(id, node) of all nodes of checkpointed edges (src, dst) and of `more` (node, ...), and these frames with ids for nodes.

    None if there are more edges than one task should hold, or if two nodes have one hash.
    """
    if edges.count() > packed.IN_TASK:
        return None
    ends = [edges.select(F.col(c).alias("node")) for c in edges.columns] + [df.select("node") for df in more]
    names = cut(reduce(DataFrame.union, ends).groupBy(F.xxhash64("node").alias("id")).agg(F.min("node").alias("node"), (F.min("node") < F.max("node")).alias("clash")))
    if not names.where("clash").isEmpty():
        return None
    return names.select("id", "node"), *(df.select(*[F.xxhash64(c).alias(c) if c in ("src", "dst", "node") else F.col(c) for c in df.columns]) for df in (edges, *more))


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, stop: DataFrame | None = None, hops: int = 4) -> DataFrame:
    """(node, depth), or (source, node, depth) if the seeds have a source; seeds are at depth 0.

    `edges` has src and dst, `seeds` node.  Nodes of `stop` (node) are reached but not gone on from, unless
    they are seeds.
    """
    if "source" in seeds.columns:
        return _reach_by_joins(edges, seeds, max_depth, stop, hops)
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst"))
    seeds = cut(seeds.select("node").where("node is not null").distinct())
    halts = None if stop is None else cut(stop.select("node").where("node is not null").distinct())
    packed_ = coded(edges, seeds, *([] if halts is None else [halts]))
    if packed_ is None:
        return _reach_by_joins(edges, seeds, max_depth, halts, hops)
    names, own, first, *last = packed_

    def walk(given: dict) -> dict:
        ids, src, dst, (begin, end) = packed.numbered(given["edges"], given["seeds"][:, 0], given["stop"][:, 0])
        depth = packed.depths(packed.Packed(src, dst, len(ids)), begin, end, max_depth)
        found = (depth >= 0).nonzero()[0]
        return {"id": ids[found], "depth": depth[found]}

    found = packed.in_task({"edges": own, "seeds": first, "stop": last[0] if last else first.limit(0)}, walk, "id bigint, depth int")
    return cut(found.join(names, "id").select("node", "depth"))


def _reach_by_joins(edges: DataFrame, seeds: DataFrame, max_depth: int | None, stop: DataFrame | None, hops: int) -> DataFrame:
    """`reach` for any number of edges: each round walks up to `hops` edges and writes only what it found to a checkpoint of its own;
    what was found before is read, never written again.  The frontier is joined with the edges, so the engine
    broadcasts it while its measured size allows.
    """
    key = [c for c in ("source", "node") if c in seeds.columns]
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    onward = edges if stop is None else cut(edges.join(stop.select(F.col("node").alias("src")).distinct(), "src", "left_anti"))
    layers = [cut(seeds.select(*key).where("node is not null").distinct().withColumn("depth", F.lit(0)))]
    frontier, depth = layers[0], 0
    while max_depth is None or depth < max_depth:
        steps = hops if max_depth is None else min(hops, max_depth - depth)
        walked, last = [], frontier.select(*key)
        for i in range(steps):
            over = edges if depth + i == 0 else onward
            last = last.join(over, last.node == over.src).select(*[c for c in key if c != "node"], F.col("dst").alias("node")).distinct()
            walked.append(last.withColumn("depth", F.lit(depth + i + 1)))
        new = reduce(DataFrame.unionByName, walked).groupBy(*key).agg(F.min("depth").alias("depth"))
        seen = reduce(DataFrame.unionByName, layers).select(*key)
        layers.append(cut(new.join(seen, key, "left_anti")))
        # a node found at the last of these hops is the frontier; those before have been walked on from
        depth += steps
        frontier = layers[-1].where(F.col("depth") == depth)
        if frontier.isEmpty():
            break
        if len(layers) > LAYERS:
            layers = [cut(reduce(DataFrame.unionByName, layers))]
    return reduce(DataFrame.unionByName, layers)


def least_source(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, rank): the least rank of the seeds (node, rank BIGINT) that lead to a node along edges (src, dst), a seed to itself too.

    One number a node is kept and sent on while it falls, never a row for each seed and node.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst"))
    best = cut(seeds.where("node is not null").groupBy("node").agg(F.min("rank").alias("rank")))
    packed_ = coded(edges, best)
    if packed_ is not None:
        names, own, first = packed_

        def walk(given: dict) -> dict:
            ids, src, dst, (begin,) = packed.numbered(given["edges"], given["seeds"][:, 0])
            rank = packed.least_labels(packed.Packed(src, dst, len(ids)), begin, given["seeds"][:, 1])
            found = (rank < 2**63 - 1).nonzero()[0]
            return {"id": ids[found], "rank": rank[found]}

        return cut(packed.in_task({"edges": own, "seeds": first}, walk, "id bigint, rank bigint").join(names, "id").select("node", "rank"))
    moved = best
    while not moved.isEmpty():
        sent = moved.join(edges, moved.node == edges.src).groupBy("dst").agg(F.min("rank").alias("low"))
        new = cut(best.join(sent, best.node == sent.dst, "full").select(F.coalesce("node", "dst").alias("node"), F.least("rank", "low").alias("rank"), (F.col("rank").isNull() | (F.col("low") < F.col("rank"))).alias("moved")))
        best, moved = new.select("node", "rank"), new.where("moved").select("node", "rank")
    return best


def all_pairs(edges: DataFrame, nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(source, node, depth) from every node; a node in a cycle doesn't list itself."""
    return reach(edges, nodes.select(F.col("node").alias("source"), "node"), max_depth).where("depth > 0")


def by_blocks(edges: DataFrame, nodes: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, pa.Array, np.ndarray, bool], Iterator[dict]], out: str) -> DataFrame | None:
    """Rows that `kernel` makes for every node (node STRING), a connected component at a time; None if there are too many edges for that.

    The kernel gets a component's edges by number (src, dst), its names, the numbers it has to answer for, and whether it is the first to
    get this component: a large component goes to several tasks, each with a share of its nodes.
    """
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst"))
    nodes = cut(nodes.select("node").where("node is not null").distinct())
    packed_ = coded(edges, nodes)
    if packed_ is None:
        return None
    names, own, asked = packed_
    spark = edges.sparkSession
    tasks = max(BLOCKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def split(given: dict) -> dict:
        ids, src, dst, _ = packed.numbered(given["edges"], given["nodes"][:, 0])
        part = packed.weak_components(src, dst, len(ids))
        many = np.bincount(part, minlength=len(ids))
        return {"id": ids, "part": part, "blocks": -(-many[part] * tasks // max(len(ids), 1))}

    part = cut(packed.in_task({"edges": own, "nodes": asked}, split, "id bigint, part bigint, blocks bigint"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    none = F.lit(None).cast("string")
    rows = own.join(part, own.src == part.id).select("part", "src", "dst", none.alias("name"), each, "blocks")
    rows = rows.union(names.join(part, "id").select("part", "id", F.lit(None).cast("bigint"), "node", each, "blocks"))
    rows = rows.join(asked.select(F.col("node").alias("src"), F.lit(True).alias("asked")), "src", "left").select("part", "block", "blocks", "src", "dst", "name", "asked")
    schema = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None:
            return
        key = np.stack([table.column("part").to_numpy(), table.column("block").to_numpy()], 1)
        order = np.lexsort((key[:, 1], key[:, 0]))
        table, key = table.take(order), key[order]
        starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        waiting, rows_ = [], 0
        for a, b in zip(starts, starts[1:]):
            one = table.slice(a, b - a)
            named = one.filter(pc.is_valid(one.column("name"))).sort_by("src")
            edge = one.filter(pc.is_null(one.column("name")))
            ids = named.column("src").to_numpy()
            src, dst = np.searchsorted(ids, edge.column("src").to_numpy()), np.searchsorted(ids, edge.column("dst").to_numpy())
            block, blocks = int(key[a, 1]), one.column("blocks")[0].as_py()
            wanted = np.flatnonzero(pc.fill_null(named.column("asked"), False).to_numpy())
            for made in kernel(src, dst, named.column("name").combine_chunks(), wanted[block::blocks], block == 0):
                waiting.append(pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in schema], schema=schema))
                rows_ += waiting[-1].num_rows
                if rows_ >= packed.BATCH:
                    yield from pa.Table.from_batches(waiting).combine_chunks().to_batches(packed.BATCH)
                    waiting, rows_ = [], 0
        yield from pa.Table.from_batches(waiting, schema).combine_chunks().to_batches(packed.BATCH)

    return rows.repartition(tasks, "part", "block").mapInArrow(run, out)


def connected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component) of all ends of the edges (src, dst), whatever their direction, and of `nodes` (node); the least node names it.

    Large-star and small-star steps by turns: a chain of n nodes takes about log n rounds, and no node's
    neighbours are ever gathered.
    """
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    every = cut((ends if nodes is None else ends.union(nodes.select("node"))).where("node is not null").distinct())
    links = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v"))
        links = cut(small.where("u <> v").distinct())
        now = tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return every.join(links, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))


def trim(edges: DataFrame) -> DataFrame:
    """What is left when nodes without a way in or without a way out are peeled off again and again."""
    rest = cut(edges.select("src", "dst").distinct())
    size = rest.count()
    while size:
        ends = rest.select(F.col("src").alias("node")).intersect(rest.select(F.col("dst").alias("node")))
        rest_ = rest.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
        rest_ = cut(rest_)
        now = rest_.count()
        rest = rest_
        if now == size:
            break
        size = now
    return rest


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on a cycle, self-loops included; the component is its least node."""
    edges = cut(edges.select("src", "dst").where("src is not null and dst is not null"))
    packed_ = coded(edges)
    if packed_ is None:
        return _components_by_joins(edges)
    names, own = packed_

    def split(given: dict) -> dict:
        ids, src, dst, _ = packed.numbered(given["edges"])
        part = packed.components(src, dst, len(ids))
        found = (part >= 0).nonzero()[0]
        return {"id": ids[found], "part": part[found]}

    member = cut(packed.in_task({"edges": own}, split, "id bigint, part bigint").join(names, "id").select("node", "part"))
    least = member.groupBy("part").agg(F.min("node").alias("component"))
    return member.join(least, "part").select("node", "component")


def _components_by_joins(edges: DataFrame) -> DataFrame:
    """`strongly_connected` for any number of edges.

    Peeling leaves little; then colours (the least node that leads to a node) split the rest, and the part
    of each colour that leads back to its own root is one component.
    """
    all_edges = cut(edges.distinct())
    loops = all_edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    rest = trim(all_edges.where("src <> dst"))
    found: list[DataFrame] = []
    while not rest.isEmpty():
        color = cut(rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct().withColumn("color", F.col("node")))
        while True:
            push = rest.join(color, rest.src == color.node).groupBy("dst").agg(F.min("color").alias("low"))
            new = cut(color.join(push, color.node == push.dst, "left").select("node", F.least("color", F.coalesce("low", "color")).alias("color"), (F.coalesce("low", "color") < F.col("color")).alias("moved")))
            moved = new.where("moved").isEmpty()
            color = new.select("node", "color")
            if moved:
                break
        a, b = color.toDF("src", "ca"), color.toDF("dst", "cb")
        inside = rest.join(a, "src").join(b, "dst").where("ca = cb")
        part = reach(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), color.where("node = color").select("node"))
        part = cut(part.join(color, "node").select("node", F.col("color").alias("component")))
        found.append(part)
        gone = part.select("node")
        left = rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        rest = trim(left)
    several = reduce(DataFrame.unionByName, found) if found else loops.limit(0)
    sized = several.groupBy("component").count().where("count > 1").select("component")
    several = several.join(sized, "component", "left_semi").select("node", "component")
    return several.unionByName(loops.join(several.select("node"), "node", "left_anti"))


def reference_cycles(edges: list[tuple[int, int, int]]) -> list[list[int]]:
    """Cycles as a depth-first walk lists them, each closed by its first node.

    Edges are (source, edge number, target) of the whole graph: the list depends on where the walk enters,
    so this order-bound listing runs in one place over integer edges.
    """
    after: dict[int, list[int]] = {}
    for a, _, b in sorted(edges):
        after.setdefault(a, []).append(b)
        after.setdefault(b, after.get(b, []))
    done: set[int] = set()
    found = []
    for root in sorted(after):
        if root in done:
            continue
        trail, on_trail = [root], {root: 0}
        todo = [iter(after[root])]
        done.add(root)
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                on_trail.pop(trail.pop())
            elif step in on_trail:
                found.append([*trail[on_trail[step] :], step])
            elif step not in done:
                done.add(step)
                on_trail[step] = len(trail)
                trail.append(step)
                todo.append(iter(after[step]))
    return found

"""Questions about one graph: dependencies, dependents, blast radius, calls, cycles, hubs, roles, API surface, types, symbols."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.plans import packed
from graphloom.plans.model import CodeGraph
from graphloom.plans.session import cut, delete, exists
from graphloom.plans.traverse import all_pairs, by_blocks, least_source, reach, reference_cycles, strongly_connected
from graphloom.sources.facts import public_entries

CALL_TYPES = tuple("go javascript python typescript".split())


def is_test(graph: CodeGraph, identify: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Paths of test files: category test, or any tag named test; or the nodes for which the caller's condition holds."""
    if identify is not None:
        return graph.nodes.where(identify(graph.nodes)).select("path").distinct()
    return graph.nodes.where("category = 'test'").select("path").union(graph.tags.where("name = 'test'").join(graph.nodes, "path", "left_semi").select("path")).distinct()


def _seeds(graph: CodeGraph, files) -> DataFrame:
    """Those of the files (a path, a list or a frame with path) that are nodes."""
    if isinstance(files, DataFrame):
        return graph.nodes.join(files.select("path"), "path", "left_semi").select(F.col("path").alias("node"))
    return graph.nodes.where(F.col("path").isin([files] if isinstance(files, str) else list(files))).select(F.col("path").alias("node"))


def _edges(graph: CodeGraph) -> DataFrame:
    return graph.internal().select("src", "dst")


def _reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _numbered(graph: CodeGraph, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, path) and the edges by number: pairs of many sources are kept and compared as integers and named at the end."""
    number = cut(graph.nodes.select(F.col("node_seq").alias("node"), "path"))
    a, b = number.toDF("a", "src"), number.toDF("b", "dst")
    return number, edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def dependencies(graph: CodeGraph, file: str, depth: int = 1) -> DataFrame:
    """(path, depth, symbols) within `depth` hops; symbols are those of the first edge from the file one hop nearer.

    Of several files one hop nearer the first in node order counts.
    """
    inner = graph.internal().where("src <> dst")
    if depth == 1:
        own = inner.where(F.col("src") == file).groupBy("dst").agg(F.min_by(F.struct("symbols"), "edge_seq").alias("v"))
        return own.select(F.col("dst").alias("path"), F.lit(1).alias("depth"), "v.symbols")
    inner = cut(inner)
    found = reach(inner.select("src", "dst"), _seeds(graph, file), depth)
    near = found.join(graph.nodes.select(F.col("path").alias("node"), "node_seq"), "node").select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"), "node_seq")
    far = found.where("depth > 0").select(F.col("node").alias("dst"), "depth")
    parents = inner.join(near, "src").join(far, ["dst", "depth"])
    best = parents.groupBy("dst", "depth").agg(F.min_by(F.struct("symbols"), F.struct("node_seq", "edge_seq")).alias("v"))
    return best.select(F.col("dst").alias("path"), "depth", "v.symbols")


def dependents(graph: CodeGraph, file: str) -> DataFrame:
    """(path, symbols) of direct importers, symbols of the first edge of each; nothing for a file outside the graph."""
    return graph.internal().where((F.col("dst") == file) & (F.col("src") != file)).groupBy("src").agg(F.min_by("symbols", "edge_seq").alias("symbols")).withColumnRenamed("src", "path")


def affected(graph: CodeGraph, file: str, tests_only: bool = False, changed_symbols: list[str] | None = None, identify: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(path, depth) of all files that depend on `file`.

    With changed symbols only importers count whose first edge names one of them, "default", "*" or the
    whole module; beyond that first hop everything follows.
    """
    edges = _reverse(_edges(graph))
    if changed_symbols is None:
        found = reach(edges, _seeds(graph, file)).where("depth > 0")
    else:
        first = dependents(graph, file)
        names = F.array(*[F.lit(s) for s in dict.fromkeys(["default", "*", *changed_symbols])])
        hit = first if "*" in changed_symbols else first.where(F.col("symbols").isNull() | F.arrays_overlap("symbols", names))
        found = reach(edges, hit.select(F.col("path").alias("node"))).withColumn("depth", F.col("depth") + 1).where(F.col("node") != file)
    found = found.select(F.col("node").alias("path"), "depth")
    return found.join(is_test(graph, identify), "path", "left_semi") if tests_only else found


def callers(graph: CodeGraph, file: str, depth: int = 1) -> DataFrame:
    """(path, depth, edges) of files that call into `file` within `depth` call hops; edges (from, to) that end in it."""
    inner = graph.calls.join(graph.nodes.select(F.col("path").alias("to_file")), "to_file", "left_semi")
    found = reach(inner.select(F.col("to_file").alias("src"), F.col("path").alias("dst")), _seeds(graph, file), depth).where("depth > 0")
    own = inner.where(F.col("to_file") == file).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("from_fn", "to_fn"))).alias("edges"))
    return found.withColumnRenamed("node", "path").join(own, "path", "left")


def neighbours(graph: CodeGraph, file: str, incoming: bool = False) -> DataFrame:
    """Node rows one import away, a row for each edge."""
    a, b = ("dst", "src") if incoming else ("src", "dst")
    return graph.internal().where(F.col(a) == file).select(F.col(b).alias("path")).join(graph.nodes, "path")


def call_edges(graph: CodeGraph, file: str) -> DataFrame:
    return graph.calls.where(F.col("path") == file).select("from_fn", "to_fn", "to_file")


def impact_pairs(graph: CodeGraph) -> DataFrame:
    """(path, affected, depth) for every file: the change-impact cache as a table.

    There are as many rows as files times what depends on them; each task walks from its share of the files and names
    what it finds, so no pair is shuffled or kept.
    """

    def walk(src, dst, names, starts, first):
        walker = packed.Walker(packed.Packed(dst, src, len(names)))
        for start in starts.tolist():
            found, depth = walker.found(start)
            if len(found):
                yield {"path": names.take(pa.array(np.full(len(found), start))), "affected": names.take(pa.array(found)), "depth": pa.array(depth)}

    pairs = by_blocks(_edges(graph), graph.nodes.select(F.col("path").alias("node")), walk, "path string, affected string, depth int")
    if pairs is not None:
        return pairs
    number, edges = _numbered(graph, _edges(graph))
    found = all_pairs(_reverse(edges), number.select("node")).join(number, "node").select("source", F.col("path").alias("affected"), "depth")
    return found.join(number.withColumnRenamed("node", "source"), "source").select("path", "affected", "depth")


def fingerprint(graph: CodeGraph) -> DataFrame:
    """(n, fingerprint): changes with any path, mtime or size; an order-free sum of row hashes, so no row order or gathering."""
    line = F.concat_ws(":", "path", F.col("mtime").cast("bigint").cast("string"), F.col("size").cast("string"))
    part = lambda at: F.sum(F.conv(F.substring(F.md5(line), at, 8), 16, 10).cast("bigint"))
    return graph.nodes.agg(F.count("*").alias("n"), F.concat_ws("-", *[part(at).cast("string") for at in (1, 9, 17, 25)]).alias("fingerprint"))


@dataclass(frozen=True)
class Impact:
    """The blast radius of every file, and the fingerprint of the graph it was made from.

    `radius` (key, shared, base, affected) has for each file, as the key, what depends on it beyond its base, and for each base, a
    cycle of files that all of these depend on, once what depends on it, itself included.  So nothing is listed again for each
    of the files that lead out of one large cycle.
    """

    radius: DataFrame
    fingerprint: str

    def _rows(self, key: str, shared: bool) -> DataFrame:
        return self.radius.where((F.col("key") == key) & (F.col("shared") == shared))

    def lookup(self, file: str) -> DataFrame:
        """(path) of what depends on `file`; nothing for a file that isn't there."""
        own = self._rows(file, False)
        found = own.select(F.explode("affected").alias("path"))
        base = own.where("base is not null").select("base").first()
        return found if base is None else found.union(self._rows(base.base, True).select(F.explode("affected").alias("path")).where(F.col("path") != file))

    def is_current(self, graph: CodeGraph) -> bool:
        """Whether the graph still has the files, times and sizes of this table."""
        return fingerprint(graph).first().fingerprint == self.fingerprint

    def save(self, folder: str) -> None:
        """Partitioned by a hash of the key, so that a lookup reads two parts at most; the fingerprint is written last."""
        delete(self.radius.sparkSession, f"{folder}/fingerprint")
        self.radius.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(IMPACT_PARTS)).cast("int")).repartition("part").sortWithinPartitions("key").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/radius")
        self.radius.sparkSession.range(1).select(F.lit(self.fingerprint).alias("fingerprint")).write.mode("overwrite").parquet(f"{folder}/fingerprint")


#: Parts of a saved impact table.
IMPACT_PARTS = 64
#: Paths in one row of what depends on a base.
IMPACT_ROW = 5000
_RADIUS = "key STRING, shared BOOLEAN, base STRING, affected ARRAY<STRING>"


def build_impact(graph: CodeGraph) -> Impact:
    """Computed once and kept in the shared folder."""

    def walk(src, dst, names, starts, first):
        base, shared = packed.cores(dst, src, len(names))
        walker, shut = packed.Walker(packed.Packed(dst, src, len(names))), np.zeros(len(names), bool)
        lists = lambda ends, nodes: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(nodes)))
        for name, reached in [*shared, (-1, np.zeros(0, np.int64))]:
            for i in range(0, len(reached), IMPACT_ROW) if first else ():
                part = reached[i : i + IMPACT_ROW]
                yield {"key": names.take(pa.array([name])), "shared": pa.array([True]), "base": pa.nulls(1, pa.string()), "affected": lists([0, len(part)], part)}
            shut[reached] = True
            own = starts[base[starts] == name]
            for i in range(0, len(own), IMPACT_ROW):
                some = own[i : i + IMPACT_ROW]
                found = [reached[:0] if shut[x] else walker.found(x, shut)[0] for x in some.tolist()]
                yield {"key": names.take(pa.array(some)), "shared": pa.array(np.zeros(len(some), bool)), "base": names.take(pa.array(np.full(len(some), name), mask=np.full(len(some), name < 0))), "affected": lists(np.cumsum([0, *map(len, found)]), np.concatenate(found).astype(np.int64))}
            shut[reached] = False

    radius = by_blocks(_edges(graph), graph.nodes.select(F.col("path").alias("node")), walk, _RADIUS)
    if radius is None:
        each = impact_pairs(graph).groupBy(F.col("path").alias("key")).agg(F.collect_list("affected").alias("affected"))
        radius = each.select("key", F.lit(False).alias("shared"), F.lit(None).cast("string").alias("base"), "affected")
    return Impact(cut(radius), fingerprint(graph).first().fingerprint)


def load_impact(spark: SparkSession, folder: str) -> Impact | None:
    """The saved table; None if there is none or its writing wasn't finished."""
    if not exists(spark, f"{folder}/fingerprint/_SUCCESS") or not exists(spark, f"{folder}/radius"):
        return None
    return _SavedImpact(spark.read.schema(f"{_RADIUS}, part INT").parquet(f"{folder}/radius"), spark.read.parquet(f"{folder}/fingerprint").first().fingerprint)


class _SavedImpact(Impact):
    def _rows(self, key: str, shared: bool) -> DataFrame:
        return super()._rows(key, shared).where(F.col("part") == F.pmod(F.xxhash64(F.lit(key)), F.lit(IMPACT_PARTS)).cast("int"))


def cycle_members(graph: CodeGraph) -> DataFrame:
    """(path, component) of the files on import cycles."""
    return strongly_connected(_edges(graph)).select(F.col("node").alias("path"), "component")


def cycles(graph: CodeGraph) -> DataFrame:
    """(cycle): the closed cycles that a depth-first walk in node order meets.

    The walk is order-bound, so it runs over integer edges of the cyclic components, in one task for each
    component; a walk that starts outside enters a component at its least reachable node.
    """
    numbered = graph.nodes.select("path", "node_seq")
    member = cycle_members(graph)
    a, b = member.toDF("src", "ca"), member.toDF("dst", "cb")
    seq = numbered.toDF("src", "a").distinct(), numbered.toDF("dst", "b").distinct()
    inner = graph.internal().join(a, "src").join(b, "dst").where("ca = cb").join(seq[0], "src").join(seq[1], "dst").select(F.col("ca").alias("component"), "a", "edge_seq", "b", "src", "dst")

    def walk(pdf):
        import pandas as pd

        names = dict(zip(pdf.a, pdf.src)) | dict(zip(pdf.b, pdf.dst))
        found = reference_cycles(list(zip(pdf.a.tolist(), pdf.edge_seq.tolist(), pdf.b.tolist())))
        return pd.DataFrame({"cycle": [[names[i] for i in c] for c in found]})

    return inner.groupBy("component").applyInPandas(walk, "cycle array<string>")


def first_cycles(graph: CodeGraph, most_edges: int = 5_000_000) -> list[list[str]]:
    """`cycles` in the very order of a single walk over all files in node order, each entered where that walk enters it.

    The walk is one task by nature, so edges that can't lie on or before a cycle are left out, and above `most_edges` this is refused.
    """
    seq = graph.nodes.select("path", "node_seq")
    inner = cut(graph.internal().select("src", "dst", "edge_seq"))
    # only files from which a cycle can be reached matter, and those are few in most graphs
    toward = reach(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), cycle_members(graph).select(F.col("path").alias("node"))).select("node")
    kept = inner.join(toward.withColumnRenamed("node", "src"), "src", "left_semi").join(toward.withColumnRenamed("node", "dst"), "dst", "left_semi")
    kept = cut(kept.join(seq.toDF("src", "a"), "src").join(seq.toDF("dst", "b"), "dst").select("a", "edge_seq", "b", "src", "dst"))
    if kept.count() > most_edges:
        raise ValueError(f"more than {most_edges} edges lead to cycles: use cycles() instead")
    rows = kept.collect()
    names = {r.a: r.src for r in rows} | {r.b: r.dst for r in rows}
    return [[names[i] for i in c] for c in reference_cycles([(r.a, r.edge_seq, r.b) for r in rows])]


def unused_files(graph: CodeGraph, files: DataFrame) -> DataFrame:
    """Files on disk (path) that aren't in the graph."""
    return files.select("path").join(graph.nodes, "path", "left_anti")


def out_degrees(graph: CodeGraph) -> DataFrame:
    return _edges(graph).groupBy("src").agg(F.count("*").alias("out_degree")).withColumnRenamed("src", "path")


def hub_label(path: Column) -> Column:
    """File name without extension; of an index file, its folder's name."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folder = F.when(F.size(F.split(path, "/")) > 1, F.element_at(F.split(path, "/"), -2))
    return F.when(stem == "index", F.coalesce(folder, stem)).otherwise(stem)


#: Orders hubs that reach one file: the least comes first.
HUB_ORDER = ("out_degree", "node_seq")


def feature_hubs(graph: CodeGraph, min_out_degree: int = 5, detect: Callable[[CodeGraph], DataFrame] | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(path, label, out_degree, node_seq) of files, neither tests nor barrels, with so many internal imports, highest first.

    `detect` gives the hubs (path) instead; `edges` are the graph's, if they are there already.
    """
    degrees = (_edges(graph) if edges is None else edges).groupBy("src").agg(F.count("*").alias("out_degree")).withColumnRenamed("src", "path")
    nodes = graph.nodes.select("path", "node_seq", "category")
    if detect is not None:
        found = nodes.join(detect(graph).select("path").distinct(), "path", "left_semi").join(degrees, "path", "left").withColumn("out_degree", F.coalesce("out_degree", F.lit(0)))
    else:
        found = degrees.where(F.col("out_degree") >= min_out_degree).join(nodes.where("category not in ('test', 'barrel')"), "path")
    return found.select("path", hub_label(F.col("path")).alias("label"), "out_degree", "node_seq").orderBy(F.desc("out_degree"), "node_seq")


def _assigned(graph: CodeGraph, edges: DataFrame, hubs: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """A file goes to the least of the hubs that lead to it, so that one rank a file is carried along, not a row for each hub and file."""
    ranked = cut(hubs.select("path", F.row_number().over(Window.orderBy(F.struct(*order), "node_seq")).cast("bigint").alias("rank")))
    best = least_source(edges, ranked.select(F.col("path").alias("node"), "rank")).join(ranked.select(F.col("path").alias("hub"), "rank"), "rank")
    return best.select(F.col("node").alias("path"), "hub").join(hubs.select("path"), "path", "left_anti")


def feature_assignment(graph: CodeGraph, min_out_degree: int = 5, detect: Callable[[CodeGraph], DataFrame] | None = None, order: Sequence[Column | str] = HUB_ORDER) -> DataFrame:
    """(path, hub): each file that hubs reach goes to the one with the least out-degree, ties to the first, or the least by `order`."""
    edges = cut(_edges(graph))
    return _assigned(graph, edges, cut(feature_hubs(graph, min_out_degree, detect, edges)), order)


def feature_domains(graph: CodeGraph, min_out_degree: int = 5, detect: Callable[[CodeGraph], DataFrame] | None = None, order: Sequence[Column | str] = HUB_ORDER) -> tuple[DataFrame, DataFrame]:
    """Domains (label, hub, files), of hubs with one label the last; and the files of no hub (path)."""
    edges = cut(_edges(graph))
    hubs = cut(feature_hubs(graph, min_out_degree, detect, edges))
    own = cut(_assigned(graph, edges, hubs, order))
    files = own.groupBy("hub").agg(F.array_sort(F.collect_list("path")).alias("files"))
    last = hubs.groupBy("label").agg(F.max_by("path", "node_seq").alias("hub"))
    domains = last.join(files, "hub", "left").select("label", "hub", F.coalesce("files", F.array().cast("array<string>")).alias("files"))
    return domains, graph.nodes.select("path").join(own, "path", "left_anti").join(hubs, "path", "left_anti")


#: Role -> path segments, most specific first; "=x" is a file stem.
ROLES = (
    ("component", "component", "components"), ("controller", "controller", "controllers"), ("middleware", "middleware"), ("router", "router", "routes", "route"),
    ("store", "store", "stores"), ("service", "service", "services"), ("handler", "handler", "handlers"), ("adapter", "adapter", "adapters"), ("plugin", "plugin", "plugins"),
    ("api", "api"), ("cli", "cli", "commands", "=cli"), ("util", "util", "utils", "helper", "helpers"), ("model", "model", "models", "=model"),
    ("parser", "parser", "parsers", "=parser"), ("builder", "=builder"), ("resolver", "=resolver"),
)


def role(path: Column, category: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    test = lambda s: stem == s[1:] if s.startswith("=") else path.contains(f"/{s}/") | path.contains(f"/{s}.")
    out = F.when(category == "test", "test").when(category == "config", "config").when(category == "type-only", "types")
    for name_, *segments in ROLES:
        out = out.when(reduce(lambda a, b: a | b, map(test, segments)), name_)
    return out.otherwise("other")


def responsibility(graph: CodeGraph, min_out_degree: int = 5, detect: Callable[[CodeGraph], DataFrame] | None = None, order: Sequence[Column | str] = HUB_ORDER) -> DataFrame:
    """(path, role, exports, hub) of every file."""
    names = graph.exports.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("exp_seq", "name"))).alias("e")).select("path", F.col("e.name").alias("exports"))
    return graph.nodes.select("path", role(F.col("path"), F.col("category")).alias("role")).join(names, "path", "left").join(feature_assignment(graph, min_out_degree, detect, order), "path", "left").select("path", "role", F.coalesce("exports", F.array().cast("array<string>")).alias("exports"), "hub")


def export_kind(signature: Column) -> Column:
    s = F.ltrim(signature)
    out = F.when(F.coalesce(signature, F.lit("")) == "", "unknown")
    for kind in ("interface", "class", "enum", "type", "namespace"):
        out = out.when(s.startswith(kind + " "), kind)
    out = out.when(s.rlike(r"^(const|let|var|readonly) "), "const")
    return out.when(s.rlike(r"^(\(|async |function )") | s.contains("=>"), "function").otherwise("unknown")


def _entries(graph: CodeGraph, entries: list[str] | DataFrame) -> DataFrame:
    """(path, rank) of the entry points, a list in its order or a frame with path in node order; an unknown one is refused."""
    if not isinstance(entries, DataFrame):
        if not entries:
            raise ValueError("an API surface needs an entry point")
        entries = graph.spark.createDataFrame(list(enumerate(dict.fromkeys(entries))), "rank LONG, path STRING")
    elif "rank" not in entries.columns:
        entries = entries.select("path").join(graph.nodes.select("path", F.col("node_seq").alias("rank")), "path", "left")
    entries = cut(entries.select("path", "rank").distinct())
    missing = entries.join(graph.nodes, "path", "left_anti").first()
    if missing is not None:
        raise ValueError(f"no such entry point in the graph: {missing.path}")
    if entries.isEmpty():
        raise ValueError("an API surface needs an entry point")
    return entries


def detect_entry_points(graph: CodeGraph, root: str) -> list[str]:
    """Files of the graph that the project's package.json publishes, in its order; else the usual index file, or nothing."""
    groups = [*public_entries(root), [[x] for x in ("src/index.ts", "src/index.js", "index.ts", "index.js")]]
    # a manifest's few names: what of them is in the graph is all that comes to the driver
    asked = sorted({c for group in groups for names in group for c in names})
    there = {r.path for r in graph.nodes.where(F.col("path").isin(asked)).select("path").collect()}
    for group in groups[:-1]:
        found = list(dict.fromkeys(hit for names in group if (hit := next((c for c in names if c in there), None))))
        if found:
            return found
    return next(([names[0]] for names in groups[-1] if names[0] in there), [])


def _accessible(graph: CodeGraph, seeds: DataFrame) -> DataFrame:
    re_exports = graph.imports.where("type = 're-export' and not coalesce(is_external, false) and to_path <> ''")
    wild = F.coalesce(F.size("symbols"), F.lit(0)) <= 0
    wild = wild | F.coalesce(F.array_contains("symbols", "*"), F.lit(False))
    through = reach(re_exports.where(wild).select(F.col("path").alias("src"), F.col("to_path").alias("dst")), seeds)
    seen = through.select(F.col("node").alias("path"))
    own = graph.exports.join(seen, "path", "left_semi").select("name")
    named = re_exports.where(~wild).join(seen, "path", "left_semi").select(F.explode("symbols").alias("name"))
    return own.union(named).distinct()


def accessible_names(graph: CodeGraph, entries: list[str] | DataFrame) -> DataFrame:
    """(name) of what the entry points export, directly and by re-export; wildcards are followed on."""
    return _accessible(graph, _entries(graph, entries).select(F.col("path").alias("node")))


def _partitions(graph: CodeGraph, entries: DataFrame, found: DataFrame) -> DataFrame:
    marked = graph.nodes.join(found.select("path", F.lit(True).alias("reached")), "path", "left").join(entries.select("path", F.lit(True).alias("is_entry")), "path", "left")
    part = F.when(F.col("is_entry"), "entry").when(F.col("reached") & (F.col("category") != "test"), "internal").when(F.col("reached"), "reachable-test").when(F.col("category") == "test", "test").otherwise("unreachable")
    return marked.select("path", part.alias("part"))


def api_partitions(graph: CodeGraph, entries: list[str] | DataFrame) -> DataFrame:
    """(path, part) of every file: entry, internal, unreachable or test; a reachable test is "reachable-test"."""
    entries = _entries(graph, entries)
    return _partitions(graph, entries, reach(_edges(graph), entries.select(F.col("path").alias("node"))).withColumnRenamed("node", "path"))


def api_surface(graph: CodeGraph, entries: list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Public exports (name, defined_in, kind, doc, signature) by name, and the partition of the files.

    A name's definition outside the entry points is the last one with a signature or doc in a file that is no
    barrel, else the first; files go by distance, then node_seq.
    """
    entries = _entries(graph, entries)
    seeds = entries.select(F.col("path").alias("node"))
    found = reach(_edges(graph), seeds).withColumnRenamed("node", "path")
    order = F.struct("depth", "node_seq", "exp_seq")
    concrete = (F.coalesce(F.length("signature"), F.lit(0)) + F.coalesce(F.length("doc"), F.lit(0)) > 0) & (F.col("category") != "barrel")
    value = F.struct("path", "doc", "signature")
    defined = graph.exports.join(found.join(entries, "path", "left_anti"), "path").join(graph.nodes.select("path", "node_seq", "category"), "path").groupBy("name").agg(F.max_by(value, F.when(concrete, order)).alias("best"), F.min_by(value, order).alias("first")).select("name", F.coalesce("best", "first").alias("d"))
    own = graph.exports.join(entries, "path").groupBy("name").agg(F.min_by(value, F.struct("rank", "exp_seq")).alias("own"))
    pick = F.coalesce("d", "own")
    first = entries.orderBy("rank", "path").first().path
    public = _accessible(graph, seeds).join(defined, "name", "left").join(own, "name", "left")
    public = public.select("name", F.coalesce(pick["path"], F.lit(first)).alias("defined_in"), export_kind(pick["signature"]).alias("kind"), pick["doc"].alias("doc"), pick["signature"].alias("signature"))
    return public.orderBy(F.collate("name", "UNICODE")), _partitions(graph, entries, found)


def type_nodes(graph: CodeGraph) -> DataFrame:
    """(file, name, kind, doc, node_seq) of types exported by TypeScript and JavaScript files."""
    scripts = graph.nodes.where("type in ('typescript', 'javascript')").select("path", "category", "node_seq")
    sig = F.coalesce("signature", F.lit(""))
    kind = F.when(sig.startswith("interface "), "interface").when(sig.startswith("class "), "class").when(sig.startswith("enum "), "enum").otherwise("type")
    rows = graph.exports.join(scripts, "path").where((F.col("category") == "type-only") | (kind != "type"))
    # a name exported twice by a file: the last one counts
    return rows.groupBy(F.col("path").alias("file"), "name").agg(F.max_by(F.struct(kind.alias("kind"), "doc", "node_seq"), "exp_seq").alias("v")).select("file", "name", "v.kind", "v.doc", "v.node_seq")


def type_edges(graph: CodeGraph) -> DataFrame:
    """(from_file, to_type, to_file) of imports of a known type by a script."""
    scripts = graph.nodes.where("type in ('typescript', 'javascript')").select("path")
    used = graph.imports.where("not coalesce(is_external, false) and to_path <> ''").join(scripts, "path", "left_semi").select(F.col("path").alias("from_file"), F.col("to_path").alias("to_file"), F.explode("symbols").alias("to_type"))
    known = type_nodes(graph).select(F.col("file").alias("to_file"), F.col("name").alias("to_type"))
    return used.join(known, ["to_file", "to_type"], "left_semi").select("from_file", "to_type", "to_file")


def query_type(graph: CodeGraph, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first type of that name, the files that use it (file), and the types its file uses (file, name)."""
    target = type_nodes(graph).where(F.col("name") == name).orderBy("node_seq", "file").limit(1)
    edges = type_edges(graph)
    of = target.select(F.col("file").alias("target"))
    used_by = edges.where(F.col("to_type") == name).join(of, F.col("to_file") == F.col("target"), "left_semi").select(F.col("from_file").alias("file")).distinct()
    uses = edges.join(of, F.col("from_file") == F.col("target"), "left_semi").select(F.col("to_file").alias("file"), F.col("to_type").alias("name")).distinct()
    return target, used_by, uses


def call_graph(graph: CodeGraph, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The last definer of a function (path), its callers by name (path, from_fn), and its callees (to_file, to_fn)."""
    definer = graph.exports.where(F.col("name") == name).join(graph.nodes.select("path", "node_seq"), "path").agg(F.max_by("path", "node_seq").alias("path")).where("path is not null")
    return definer, graph.calls.where(F.col("to_fn") == name).select("path", "from_fn"), graph.calls.where(F.col("from_fn") == name).join(definer, "path", "left_semi").select("to_file", "to_fn")


def find_symbol(graph: CodeGraph, name: str) -> DataFrame:
    """(path, category, precision, user, via): users of every file that exports the name; user is null if there is none.

    Precision "call": callers of the name in the whole graph and their function; "file-level": importers.
    """
    found = graph.exports.where(F.col("name") == name).select("path").distinct().join(graph.nodes.select("path", "category", "type"), "path")
    exact, coarse = found.where(F.col("type").isin(*CALL_TYPES)), found.where(~F.col("type").isin(*CALL_TYPES))
    calls = graph.calls.where(F.col("to_fn") == name).select(F.col("path").alias("user"), F.col("from_fn").alias("via"), F.lit(name).alias("called"))
    exact = exact.withColumn("called", F.lit(name)).join(calls, "called", "left").select("path", "category", F.lit("call").alias("precision"), "user", "via")
    importers = graph.internal().where("src <> dst").select("src", "dst").distinct()
    coarse = coarse.join(importers, coarse.path == importers.dst, "left").select("path", "category", F.lit("file-level").alias("precision"), F.col("src").alias("user"), F.lit(None).cast("string").alias("via"))
    return exact.unionByName(coarse)


def _change_reach(graph: CodeGraph, files: list[str], hubs: DataFrame) -> DataFrame:
    return reach(_reverse(_edges(graph)), _seeds(graph, files), stop=hubs.select(F.col("path").alias("node"))).withColumnRenamed("node", "path")


def propose_tags(graph: CodeGraph, files: list[str], min_out_degree: int = 5, identify: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(tag): labels of the hubs that the changes reach or are, and the tags of the tests they reach before a hub."""
    hubs = cut(feature_hubs(graph, min_out_degree))
    found = _change_reach(graph, files, hubs)
    tests = found.where("depth > 0").join(hubs.select("path"), "path", "left_anti").select("path")
    tags = graph.tags.join(tests, "path", "left_semi").join(is_test(graph, identify), "path", "left_semi").select(F.col("name").alias("tag"))
    return hubs.join(found, "path", "left_semi").select(F.col("label").alias("tag")).union(tags).distinct()


def affected_tests(graph: CodeGraph, files: list[str], min_out_degree: int = 5, identify: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """(path) of the tests that the changes reach without passing a hub; a hub itself doesn't count."""
    hubs = cut(feature_hubs(graph, min_out_degree))
    found = _change_reach(graph, files, hubs).where("depth > 0").join(hubs.select("path"), "path", "left_anti")
    return found.select("path").join(is_test(graph, identify), "path", "left_semi").distinct()

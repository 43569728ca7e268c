"""The key:value filter language: parsing, and compilation to one Catalyst predicate.

Clauses are separated by commas and all must hold; `any(a:1|b:2)` holds if one of its clauses does.
Unknown keys and clauses without key or value are passed over.  Clauses on imports, importers or tags
become columns of at most three pre-aggregated joins, added only for queries that ask for them.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.model import CodeGraph

#: DSL key -> (field, reader)
_INT, _FLOAT, _STR = "int", "float", "str"
KEYS = {"category": _STR, "type": _STR, "path": _STR, "importsfile": _STR, "importedby": _STR, "sort": _STR, "lastauthor": _STR}
KEYS |= dict.fromkeys(("minimports", "maximports", "minsize", "maxsize", "mincoverage", "maxcoverage", "mincomplexity", "maxcomplexity", "mincognitivecomplexity", "maxcognitivecomplexity", "mincommits", "maxcommits", "limit"), _INT)
KEYS |= dict.fromkeys(("minexportusage", "maxexportusage"), _FLOAT)


@dataclass
class NodeQuery:
    category: str | None = None
    type: str | None = None
    path: str | None = None
    importsfile: str | None = None
    importedby: str | None = None
    lastauthor: str | None = None
    external: bool | None = None
    hasdocstring: bool | None = None
    isdocumented: bool | None = None
    isstale: bool | None = None
    tags: list[str] = field(default_factory=list)
    all_tags: list[str] = field(default_factory=list)
    minimports: float | None = None
    maximports: float | None = None
    minsize: float | None = None
    maxsize: float | None = None
    mincoverage: float | None = None
    maxcoverage: float | None = None
    minexportusage: float | None = None
    maxexportusage: float | None = None
    mincomplexity: float | None = None
    maxcomplexity: float | None = None
    mincognitivecomplexity: float | None = None
    maxcognitivecomplexity: float | None = None
    mincommits: float | None = None
    maxcommits: float | None = None
    sort: str | None = None
    sortdir: str = "desc"
    limit: float | None = None
    any_of: list[NodeQuery] = field(default_factory=list)

    def parts(self) -> list[NodeQuery]:
        return [self, *self.any_of]


def leading_number(text: str, whole: bool) -> float:
    """The number a text begins with, NaN if it begins with none."""
    found = re.match(r"\s*[+-]?\d+" if whole else r"\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)", text)
    return float(found.group().replace("Infinity", "inf")) if found else math.nan


def _clause(query: NodeQuery, text: str) -> bool:
    key, colon, value = text.partition(":")
    key, value = key.strip().lower(), value.strip()
    if not colon or not key or not value:
        return False
    if key in ("tag", "tags"):
        if "+" in value:
            query.all_tags += value.split("+")
        else:
            query.tags.append(value)
    elif key == "external":
        query.external = value.lower() == "true"
    elif key in ("hasdocstring", "isdocumented", "isstale"):
        setattr(query, key, value.lower() != "false")
    elif key == "sortdir":
        query.sortdir = "asc" if value.lower() == "asc" else "desc"
    elif key in KEYS:
        setattr(query, key, value if KEYS[key] == _STR else leading_number(value, KEYS[key] == _INT))
    else:
        return False
    return True


def parse(text: str) -> NodeQuery:
    query = NodeQuery()
    for part in text.split(","):
        trimmed = part.strip()
        if trimmed.lower().startswith("any(") and trimmed.endswith(")"):
            for clause in trimmed[4:-1].split("|"):
                one = NodeQuery()
                if _clause(one, clause.strip()):
                    query.any_of.append(one)
        else:
            _clause(query, part)
    return query


def _negatable(value: str, test) -> Column:
    return ~test(value[1:]) if value.startswith("!") else test(value)


def _at_least(column: Column, value: float | None, missing: float | None) -> Column | None:
    """column >= value; `missing` stands in for null, None excludes null.  NaN matches nothing."""
    if value is None:
        return None
    if math.isnan(value):
        return F.lit(False)
    return F.coalesce((column if missing is None else F.coalesce(column, F.lit(missing))) >= value, F.lit(False))


def _at_most(column: Column, value: float | None) -> Column | None:
    if value is None:
        return None
    return F.lit(False) if math.isnan(value) else F.coalesce(column, F.lit(0)) <= value


def predicate(query: NodeQuery, number: dict[str, int] | None = None) -> Column:
    """One boolean column over `prepared` nodes."""
    n, q = F.col, query
    number = number or {}
    clauses: list[Column | None] = []
    if q.category:
        clauses.append(_negatable(q.category, lambda v: n("category") == v))
    if q.type:
        clauses.append(_negatable(q.type, lambda v: n("type") == v))
    if q.lastauthor:
        clauses.append(~n("last_author").eqNullSafe(q.lastauthor[1:]) if q.lastauthor.startswith("!") else n("last_author").eqNullSafe(q.lastauthor))
    if q.path:
        clauses.append(_negatable(q.path, lambda v: n("path").contains(v)))
    if q.external is not None:
        clauses.append(F.coalesce("has_external", F.lit(False)) == q.external)
    wanted = [t for t in q.tags if not t.startswith("!")]
    barred = [t[1:] for t in q.tags if t.startswith("!")]
    names = F.coalesce("tag_names", F.array().cast("array<string>"))
    has = lambda t: F.array_contains(names, t)
    if wanted:
        clauses.append(reduce(lambda a, b: a | b, map(has, wanted)))
    clauses += [~has(t) for t in barred] + [has(t) for t in q.all_tags]
    if q.importsfile:
        clauses.append(F.coalesce(f"imports_{number['importsfile', q.importsfile]}", F.lit(False)))
    if q.importedby is not None:
        clauses.append(F.coalesce(f"by_{number['importedby', q.importedby]}", F.lit(False)))
    imports = F.coalesce("n_imports", F.lit(0)) if q.minimports is not None or q.maximports is not None else F.lit(0)
    clauses += [_at_least(imports, q.minimports, 0), _at_most(imports, q.maximports), _at_least(n("size"), q.minsize, None), _at_most(n("size"), q.maxsize)]
    truthy = lambda c, b: (F.coalesce(F.length(c), F.lit(0)) > 0) == b
    filled = lambda c, b: (F.coalesce(F.size(c), F.lit(0)) > 0) == b
    if q.hasdocstring is not None:
        clauses.append(truthy("description", q.hasdocstring))
    if q.isdocumented is not None:
        clauses.append(filled("documented_by", q.isdocumented))
    if q.isstale is not None:
        clauses.append(filled("stale_for", q.isstale))
    clauses += [_at_least(n("coverage_pct"), q.mincoverage, 101), _at_most(n("coverage_pct"), q.maxcoverage)]
    for column, low, high, missing in (("avg_export_usage", q.minexportusage, q.maxexportusage, -1), ("complexity", q.mincomplexity, q.maxcomplexity, None), ("cognitive", q.mincognitivecomplexity, q.maxcognitivecomplexity, None), ("commit_count_90d", q.mincommits, q.maxcommits, None)):
        clauses += [_at_least(n(column), low, missing), _at_most(n(column), high)]
    if q.any_of:
        clauses.append(reduce(lambda a, b: a | b, (predicate(s, number) for s in q.any_of)))
    return reduce(lambda a, b: a & b, [c for c in clauses if c is not None], F.lit(True))


def prepared(graph: CodeGraph, query: NodeQuery) -> tuple[DataFrame, dict]:
    """Nodes with the columns that the query's clauses on other tables need."""
    nodes, number = graph.nodes, {}
    for part in query.parts():
        for key in ("importsfile", "importedby"):
            if getattr(part, key) is not None:
                number.setdefault((key, getattr(part, key)), len(number))
    parts = query.parts()
    aggregates = []
    if any(p.external is not None for p in parts):
        aggregates.append(F.max(F.coalesce("is_external", F.lit(False))).alias("has_external"))
    if any(p.minimports is not None or p.maximports is not None for p in parts):
        aggregates.append(F.count("*").alias("n_imports"))
    aggregates += [F.max(F.coalesce(F.col("to_path").contains(v), F.lit(False))).alias(f"imports_{i}") for (k, v), i in number.items() if k == "importsfile"]
    if aggregates:
        nodes = nodes.join(graph.imports.groupBy("path").agg(*aggregates), "path", "left")
    importers = [F.max(F.col("path").contains(v)).alias(f"by_{i}") for (k, v), i in number.items() if k == "importedby"]
    if importers:
        nodes = nodes.join(graph.imports.where("to_path <> ''").groupBy("to_path").agg(*importers).withColumnRenamed("to_path", "path"), "path", "left")
    if any(p.tags or p.all_tags for p in parts):
        nodes = nodes.join(graph.tags.groupBy("path").agg(F.collect_set("name").alias("tag_names")), "path", "left")
    return nodes, number


SORTS = {"size": "size", "imports": "kept_imports", "commitCount90d": "commit_count_90d", "exportUsage": "avg_export_usage", "complexity": "complexity", "cognitiveComplexity": "cognitive"}


def run(graph: CodeGraph, query: NodeQuery | str) -> tuple[DataFrame, DataFrame]:
    """(nodes, imports) that match: imports keep only edges to a node that matched or without a target.

    With `sort`, nodes come in its order (missing counts as 0, ties by node_seq), `limit` after it.  A limit
    that isn't a number gives no nodes; a negative one is refused.
    """
    query = parse(query) if isinstance(query, str) else query
    nodes, number = prepared(graph, query)
    nodes = nodes.where(predicate(query, number)).drop("has_external", "n_imports", "tag_names", *[f"imports_{i}" for i in number.values()], *[f"by_{i}" for i in number.values()])
    kept = nodes.select("path")
    imports = graph.imports.join(kept, "path", "left_semi")
    whole = imports.where(F.coalesce("to_path", F.lit("")) == "")
    imports = imports.where("to_path <> ''").join(kept.select(F.col("path").alias("to_path")), "to_path", "left_semi").select(imports.columns).unionByName(whole)
    if query.sort in SORTS:
        if query.sort == "imports":
            nodes = nodes.join(imports.groupBy("path").agg(F.count("*").alias("kept_imports")), "path", "left").withColumn("kept_imports", F.coalesce("kept_imports", F.lit(0)))
        key = F.coalesce(F.col(SORTS[query.sort]), F.lit(0))
        nodes = nodes.orderBy(key.asc() if query.sortdir == "asc" else key.desc(), "node_seq")
    elif query.limit is not None:
        nodes = nodes.orderBy("node_seq")
    if query.limit is not None:
        if query.limit < 0:
            raise ValueError("limit must not be negative")
        nodes = nodes.limit(0 if math.isnan(query.limit) else int(min(query.limit, 2**31 - 1)))
    return nodes, imports


def trim_cycles(cycles: DataFrame, nodes: DataFrame) -> DataFrame:
    """The cycles (cycle) of a graph whose members all matched."""
    lost = cycles.select("cycle", F.explode("cycle").alias("path")).join(nodes.select("path"), "path", "left_anti").select("cycle").distinct()
    return cycles.join(lost, "cycle", "left_anti")


assert {f.name for f in fields(NodeQuery)} >= set(KEYS)

"""Queries over the driver tables, each with the SQL that says the same where SQL can.

The graph is the projection of `plans.virtual`; every query runs over all of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.parse import parse_table
from graphloom.functions.tokens import block_table
from graphloom.operators import duplicates, enrich, graph, reports
from graphloom.plans import dsl
from graphloom.plans.build import BuildOptions, build
from graphloom.plans.session import cut, shared_dir
from graphloom.plans.traverse import connected
from graphloom.plans.virtual import load, with_views
from graphloom.streaming import watch

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None, views: tuple[str, ...] = (), ctes: str = ""):
    def register(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = (with_views(*views) + (", " + ctes if ctes else "") + " " if views else "") + sql
        return f

    return register


def _most(df: DataFrame, column: str) -> str:
    """The most frequent value, the least of several: where the questions about one file begin."""
    return df.groupBy(column).count().orderBy(F.desc("count"), column).first()[0]


_TOP = "(SELECT {1} FROM {0} GROUP BY {1} ORDER BY count(*) DESC, {1} LIMIT 1)".format
#: The file that imports most, the one that is imported most, and the files with most outgoing and incoming calls.
_OUT, _IN, _CALLER, _CALLED = _TOP("e", "src"), _TOP("e", "dst"), _TOP("v_calls", "path"), _TOP("v_calls", "to_file")


def _importer(g) -> str:
    return _most(g.internal(), "src")


def _imported(g) -> str:
    return _most(g.internal(), "dst")


def _kept(spark: SparkSession, sf_dir: str):
    """The graph with its imports computed once, for queries that go over them again and again."""
    g = load(spark, sf_dir)
    return g.with_tables(imports=cut(g.imports))


_INT = "e AS (SELECT path AS src, to_path AS dst, edge_seq, symbol, type FROM v_imports WHERE NOT is_external)"


# ---- filter language

_TAGS = "(SELECT path FROM v_tags WHERE name = '{}')".format
_CH = "SELECT path, count(*) FILTER (WHERE ts >= c.m - INTERVAL 90 DAYS) AS n, arg_max(author, row(ts, log_seq, author)) FILTER (WHERE ts >= c.m - INTERVAL 90 DAYS) AS author, max(ts) AS last FROM v_commits, (SELECT max(ts) AS m FROM v_commits) c GROUP BY path"
_RATIO = "r AS (SELECT e.src, e.dst, e.edge_seq, floor(least(1.0, CASE WHEN e.symbol IS NULL THEN 1.0 ELSE 1 / CAST(x.n AS DOUBLE) END) * 10000 + 0.5) / 10000 AS ratio FROM e JOIN (SELECT path, count(*) AS n FROM v_exports GROUP BY path) x ON x.path = e.dst)"
_USE = "u AS (SELECT src AS path, floor(CAST(sum(CAST(round(ratio * 10000) AS BIGINT)) AS DOUBLE) / count(*) + 0.5) / 10000 AS a, max(ratio) AS m FROM r GROUP BY src)"
_DOC = "d AS (SELECT DISTINCT e.src AS doc, e.dst AS path, CASE WHEN b.category = 'logic' AND cb.last IS NOT NULL AND (ca.last IS NULL OR cb.last > ca.last) THEN true ELSE false END AS stale FROM e JOIN v_nodes a ON a.path = e.src JOIN v_nodes b ON b.path = e.dst LEFT JOIN ch ca ON ca.path = e.src LEFT JOIN ch cb ON cb.path = e.dst WHERE a.type = 'markdown' AND e.src <> e.dst)"

#: name -> (filter, SQL condition over v_nodes n, views, extra CTEs)
FILTERS: dict[str, tuple[str, str, tuple[str, ...], str]] = {
    "filter_category": ("category:logic", "n.category = 'logic'", (), ""),
    "filter_category_not": ("category:!logic", "n.category <> 'logic'", (), ""),
    "filter_type": ("type:python", "n.type = 'python'", (), ""),
    "filter_last_author": ("lastAuthor:a7", "ch.author = 'a7'", ("v_commits",), f"ch AS ({_CH})"),
    "filter_last_author_not": ("lastAuthor:!a7", "ch.author IS DISTINCT FROM 'a7'", ("v_commits",), f"ch AS ({_CH})"),
    "filter_path_substr": ("path:promo", "contains(n.path, 'promo')", (), ""),
    "filter_path_not": ("path:!_1", "NOT contains(n.path, '_1')", (), ""),
    "filter_external": ("external:true", "n.path IN (SELECT path FROM v_imports WHERE is_external)", ("v_imports",), ""),
    "filter_not_external": ("external:false", "n.path NOT IN (SELECT path FROM v_imports WHERE is_external)", ("v_imports",), ""),
    "filter_tags_any": ("tag:nation_6,tag:nation_9,tag:!nation_11", f"n.path IN (SELECT path FROM v_tags WHERE name IN ('nation_6', 'nation_9')) AND n.path NOT IN {_TAGS('nation_11')}", ("v_tags",), ""),
    "filter_tags_all": ("tag:nation_6+nation_9", f"n.path IN {_TAGS('nation_6')} AND n.path IN {_TAGS('nation_9')}", ("v_tags",), ""),
    "filter_imports_file": ("importsFile:lib-3", "n.path IN (SELECT path FROM v_imports WHERE contains(to_path, 'lib-3'))", ("v_imports",), ""),
    "filter_imported_by": ("importedBy:_1", "n.path IN (SELECT to_path FROM v_imports WHERE contains(path, '_1'))", ("v_imports",), ""),
    "filter_min_max_imports": ("minImports:2,maxImports:3", "n.path IN (SELECT path FROM v_imports GROUP BY path HAVING count(*) BETWEEN 2 AND 3)", ("v_imports",), ""),
    "filter_max_imports_zero": ("maxImports:0", "n.path NOT IN (SELECT path FROM v_imports)", ("v_imports",), ""),
    "filter_size_range": ("minSize:10,maxSize:20", "n.size BETWEEN 10 AND 20", (), ""),
    "filter_has_doc": ("hasDocstring:true", "n.description <> ''", (), ""),
    "filter_no_doc": ("hasDocstring:false", "coalesce(n.description, '') = ''", (), ""),
    "filter_is_documented": ("isDocumented:true", "n.path IN (SELECT path FROM d)", ("v_imports", "v_commits"), f"{_INT}, ch AS ({_CH}), {_DOC}"),
    "filter_is_stale": ("isStale:true", "n.path IN (SELECT doc FROM d WHERE stale)", ("v_imports", "v_commits"), f"{_INT}, ch AS ({_CH}), {_DOC}"),
    "filter_min_coverage": ("minCoverage:50", "coalesce(n.coverage_pct, 101) >= 50", (), ""),
    "filter_max_coverage": ("maxCoverage:50", "coalesce(n.coverage_pct, 0) <= 50", (), ""),
    "filter_min_export_usage": ("minExportUsage:0.3", "coalesce(u.a, -1) >= 0.3", ("v_imports", "v_exports"), f"{_INT}, {_RATIO}, {_USE}"),
    "filter_max_export_usage": ("maxExportUsage:0.3", "coalesce(u.a, 0) <= 0.3", ("v_imports", "v_exports"), f"{_INT}, {_RATIO}, {_USE}"),
    "filter_min_complexity": ("minComplexity:12", "n.complexity >= 12", (), ""),
    "filter_max_complexity": ("maxComplexity:6", "coalesce(n.complexity, 0) <= 6", (), ""),
    "filter_min_cognitive": ("minCognitiveComplexity:45", "n.cognitive >= 45", (), ""),
    "filter_max_cognitive": ("maxCognitiveComplexity:20", "coalesce(n.cognitive, 0) <= 20", (), ""),
    "filter_min_commits": ("minCommits:2", "ch.n >= 2", ("v_commits",), f"ch AS ({_CH})"),
    "filter_max_commits": ("maxCommits:1", "coalesce(ch.n, 0) <= 1", ("v_commits",), f"ch AS ({_CH})"),
    "filter_any_group": ("any(category:ui|minComplexity:13|tag:nation_7),size:ignored,maxSize:40", f"(n.category = 'ui' OR n.complexity >= 13 OR n.path IN {_TAGS('nation_7')}) AND n.size <= 40", ("v_tags",), ""),
    "filter_not_a_number": ("minSize:abc", "false", (), ""),
}


def _filter(text: str, needs: set[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = load(spark, sf_dir)
        nodes = g.nodes
        if "ch" in needs:
            nodes = nodes.join(enrich.churn(g), "path", "left")
        if "d" in needs:
            links = enrich.doc_links(g)
            nodes = nodes.join(links.groupBy("path").agg(F.collect_set("doc").alias("documented_by")), "path", "left").join(links.where("stale").groupBy(F.col("doc").alias("path")).agg(F.collect_set("path").alias("stale_for")), "path", "left")
        if "u" in needs:
            nodes = nodes.join(enrich.export_usage(g), "path", "left")
        return dsl.run(g.with_tables(nodes=nodes), text)[0].select("node_seq", "path", "type", "category")

    return run


for _name, (_text, _where, _views, _ctes) in FILTERS.items():
    _needs = {x for x in ("ch", "d", "u") if f"{x} AS (" in _ctes}
    _join = " LEFT JOIN ch ON ch.path = n.path" * ("ch." in _where) + " LEFT JOIN u ON u.path = n.path" * ("u." in _where)
    _add(_name, f"SELECT n.node_seq, n.path, n.type, n.category FROM v_nodes n{_join} WHERE {_where}", ("v_nodes", *_views), _ctes)(_filter(_text, _needs))


@_add("query_trim_edges", "SELECT path, edge_seq, to_path, type FROM v_imports WHERE path IN (SELECT path FROM v_nodes WHERE category = 'logic') AND to_path IN (SELECT path FROM v_nodes WHERE category = 'logic')", ("v_nodes", "v_imports"))
def query_trim_edges(spark, sf_dir):
    return dsl.run(load(spark, sf_dir), "category:logic")[1].select("path", "edge_seq", "to_path", "type")


_SORTED = "k AS (SELECT n.node_seq, n.path, n.category, n.size FROM v_nodes n WHERE n.category = 'logic' AND n.path IN (SELECT path FROM v_imports GROUP BY path HAVING count(*) >= 2)), t AS (SELECT i.path, count(*) AS c FROM v_imports i WHERE i.path IN (SELECT path FROM k) AND i.to_path IN (SELECT path FROM k) GROUP BY i.path)"


@_add("query_sort_limit", "SELECT k.node_seq, k.path, k.category, k.size, CAST(coalesce(t.c, 0) AS BIGINT) AS kept_imports FROM k LEFT JOIN t ON t.path = k.path ORDER BY coalesce(t.c, 0) DESC, k.node_seq LIMIT 20", ("v_nodes", "v_imports"), _SORTED)
def query_sort_limit(spark, sf_dir):
    return dsl.run(load(spark, sf_dir), "category:logic,minImports:2,sort:imports,limit:20")[0].select("node_seq", "path", "category", "size", "kept_imports")


@_add("slim_projection", "SELECT n.path, n.type, n.category, coalesce((SELECT count(*) FROM v_exports x WHERE x.path = n.path), 0) AS n_exports, coalesce((SELECT string_agg(DISTINCT name, ' ' ORDER BY name) FROM v_tags t WHERE t.path = n.path), '') AS tags, coalesce((SELECT string_agg(to_path, ' ' ORDER BY to_path) FROM v_imports i WHERE i.path = n.path AND NOT is_external), '') AS imports_files FROM v_nodes n", ("v_nodes", "v_exports", "v_tags", "v_imports"))
def slim_projection(spark, sf_dir):
    s = reports.slim(load(spark, sf_dir))
    return s.select("path", "type", "category", F.size("exports").cast("bigint").alias("n_exports"), F.concat_ws(" ", "tags").alias("tags"), F.concat_ws(" ", "imports_files").alias("imports_files"))


# ---- one hop and reachability


@_add("dependencies_d1", f"SELECT dst AS path, 1 AS depth, symbol FROM e WHERE src = {_OUT} AND dst <> src", ("v_nodes", "v_imports"), _INT)
def dependencies_d1(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return graph.dependencies(g, _importer(g)).select("path", "depth", F.get("symbols", F.lit(0)).alias("symbol"))


_FOUND = f"{_INT}, b AS (SELECT {_OUT} AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 3), f AS (SELECT node, CAST(min(depth) AS INT) AS depth FROM b GROUP BY node)"


@_add("dependencies_d3", "SELECT x.node AS path, x.depth, min_by(struct_pack(s := e.symbol), row(n.node_seq, e.edge_seq)).s AS symbol FROM f x JOIN f y ON y.depth = x.depth - 1 JOIN e ON e.src = y.node AND e.dst = x.node JOIN v_nodes n ON n.path = y.node GROUP BY x.node, x.depth", ("v_nodes", "v_imports"), _FOUND)
def dependencies_d3(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return graph.dependencies(g, _importer(g), 3).select("path", "depth", F.get("symbols", F.lit(0)).alias("symbol"))


@_add("dependents", f"SELECT src AS path, symbol FROM e WHERE dst = {_IN} AND src <> dst", ("v_nodes", "v_imports"), _INT)
def dependents(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return graph.dependents(g, _imported(g)).select("path", F.get("symbols", F.lit(0)).alias("symbol"))


@_add("dependents_with_meta", f"SELECT e.src AS path, n.category, CAST(coalesce(x.c, 0) AS BIGINT) AS n_exports FROM e JOIN v_nodes n ON n.path = e.src LEFT JOIN (SELECT path, count(*) AS c FROM v_exports GROUP BY path) x ON x.path = e.src WHERE e.dst = {_IN} AND e.src <> e.dst", ("v_nodes", "v_imports", "v_exports"), _INT)
def dependents_with_meta(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return reports.with_meta(g, graph.dependents(g, _imported(g))).select("path", "category", F.size("exports").cast("bigint").alias("n_exports"))


_BACK = f"{_INT}, b AS (SELECT {_IN} AS node UNION SELECT e.src FROM b JOIN e ON e.dst = b.node)"
_TESTS = "path IN (SELECT path FROM v_nodes WHERE category = 'test' UNION SELECT path FROM v_tags WHERE name = 'test')"


@_add("affected", f"SELECT node AS path FROM b WHERE node <> {_IN}", ("v_nodes", "v_imports"), _BACK)
def affected(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return graph.affected(g, _imported(g)).select("path")


@_add("affected_tests_only", f"SELECT path FROM (SELECT node AS path FROM b WHERE node <> {_IN}) WHERE {_TESTS}", ("v_nodes", "v_imports", "v_tags"), _BACK)
def affected_tests_only(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return graph.affected(g, _imported(g), tests_only=True).select("path")


_SYMBOL = f"(SELECT min(symbol) FROM e WHERE dst = {_IN})"


@_add("affected_symbols", f"SELECT node AS path FROM b WHERE node <> {_IN}", ("v_nodes", "v_imports"), f"{_INT}, b AS (SELECT src AS node FROM e WHERE dst = {_IN} AND (symbol IS NULL OR symbol IN ('default', '*', {_SYMBOL})) UNION SELECT e.src FROM b JOIN e ON e.dst = b.node)")
def affected_symbols(spark, sf_dir):
    g = _kept(spark, sf_dir)
    file = _imported(g)
    symbol = g.internal().where(F.col("dst") == file).select(F.explode("symbols").alias("s")).agg(F.min("s")).first()[0]
    return graph.affected(g, file, changed_symbols=[symbol] if symbol else []).select("path")


@_add("impact_lookup", f"SELECT node AS path FROM b WHERE node <> {_IN}", ("v_nodes", "v_imports"), _BACK)
def impact_lookup(spark, sf_dir):
    """Every file's blast radius is written to the shared folder, read back, found current and asked for one file."""
    g, folder = _kept(spark, sf_dir), f"{shared_dir(spark)}/graphloom-impact-{uuid.uuid4().hex}"
    graph.build_impact(g).save(folder)
    kept = graph.load_impact(spark, folder)
    if not kept.is_current(g):
        raise RuntimeError("the graph didn't change")
    return kept.lookup(_imported(g))


@_add("reachable_files", f"SELECT node AS path FROM b", ("v_nodes", "v_imports"), f"{_INT}, b AS (SELECT {_OUT} AS node UNION SELECT e.dst FROM b JOIN e ON e.src = b.node)")
def reachable_files(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return graph.reach(graph._edges(g), graph._seeds(g, _importer(g))).select(F.col("node").alias("path"))


@_add("callers", f"SELECT path, depth, n_edges FROM (SELECT node AS path, CAST(min(depth) AS INT) AS depth FROM b GROUP BY node HAVING min(depth) > 0) LEFT JOIN (SELECT path, count(*) AS n_edges FROM v_calls WHERE to_file = {_CALLED} GROUP BY path) USING (path)", ("v_nodes", "v_calls"), f"b AS (SELECT {_CALLED} AS node, 0 AS depth UNION SELECT c.path, b.depth + 1 FROM b JOIN v_calls c ON c.to_file = b.node WHERE b.depth < 2)")
def callers(spark, sf_dir):
    g = load(spark, sf_dir)
    g = g.with_tables(calls=cut(g.calls))
    return graph.callers(g, _most(g.calls, "to_file"), 2).select("path", "depth", F.when(F.col("edges").isNotNull(), F.size("edges").cast("bigint")).alias("n_edges"))


@_add("neighbours", f"SELECT n.path, n.type, n.category FROM e JOIN v_nodes n ON n.path = e.dst WHERE e.src = {_OUT}", ("v_nodes", "v_imports"), _INT)
def neighbours(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return graph.neighbours(g, _importer(g)).select("path", "type", "category")


@_add("call_edges", f"SELECT from_fn, to_fn, to_file FROM v_calls WHERE path = {_CALLER}", ("v_nodes", "v_calls"))
def call_edges(spark, sf_dir):
    g = load(spark, sf_dir)
    return graph.call_edges(g, _most(g.calls, "path")).select("from_fn", "to_fn", "to_file")


@_add("impact_all_pairs", "SELECT src AS path, node AS affected FROM b WHERE src <> node", ("v_nodes", "v_imports"), f"{_INT}, b AS (SELECT DISTINCT dst AS src, src AS node FROM e UNION SELECT b.src, e.src FROM b JOIN e ON e.dst = b.node)")
def impact_all_pairs(spark, sf_dir):
    return graph.impact_pairs(load(spark, sf_dir)).select("path", "affected")


@_add("graph_fingerprint", "SELECT count(*) AS n, concat_ws('-', sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 17, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 25, 8))::BIGINT)::VARCHAR) AS fingerprint FROM (SELECT md5(concat_ws(':', path, CAST(CAST(mtime AS BIGINT) AS VARCHAR), CAST(size AS VARCHAR))) AS h FROM v_nodes)", ("v_nodes",))
def graph_fingerprint(spark, sf_dir):
    return graph.fingerprint(load(spark, sf_dir))


@_add("cycle_members", "SELECT DISTINCT src AS path FROM b WHERE src = node", ("v_nodes", "v_imports"), f"{_INT}, b AS (SELECT DISTINCT src, dst AS node FROM e UNION SELECT b.src, e.dst FROM b JOIN e ON e.src = b.node)")
def cycle_members(spark, sf_dir):
    return graph.cycle_members(load(spark, sf_dir)).select("path")


@_add("cycles")
def cycles(spark, sf_dir):
    return graph.cycles(_kept(spark, sf_dir))


_UND = f"{_INT}, und AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), wc(node, label) USING KEY (node) AS (SELECT path, path FROM v_nodes UNION SELECT x.dst, min(wc.label) FROM wc JOIN und x ON x.src = wc.node JOIN recurring.wc r ON r.node = x.dst WHERE wc.label < r.label GROUP BY x.dst)"


@_add("connected_files", "SELECT node AS path, label AS component FROM wc", ("v_nodes", "v_imports"), _UND)
def connected_files(spark, sf_dir):
    g = load(spark, sf_dir)
    return connected(graph._edges(g), g.nodes.select(F.col("path").alias("node"))).select(F.col("node").alias("path"), "component")


@_add("unused_files", "SELECT path FROM (SELECT path FROM v_nodes UNION ALL SELECT concat(path, '.bak') FROM v_nodes WHERE type = 'lua') WHERE path NOT IN (SELECT path FROM v_nodes)", ("v_nodes",))
def unused_files(spark, sf_dir):
    g = load(spark, sf_dir)
    return graph.unused_files(g, g.nodes.select("path").union(g.nodes.where("type = 'lua'").select(F.concat("path", F.lit(".bak")))))


# ---- hubs, roles, API surface

_LABEL = "regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '')"
_HUBS = f"h AS (SELECT e.src AS path, {_LABEL.replace('path', 'n.path')} AS label, count(*) AS out_degree, n.node_seq FROM e JOIN v_nodes n ON n.path = e.src WHERE n.category NOT IN ('test', 'barrel') GROUP BY e.src, n.node_seq, n.path HAVING count(*) >= 5)"
_ASSIGN = "g AS (SELECT path AS hub, path AS node FROM h UNION SELECT g.hub, e.dst FROM g JOIN e ON e.src = g.node), f AS (SELECT node AS path, arg_min(g.hub, row(h.out_degree, h.node_seq)) AS hub FROM g JOIN h ON h.path = g.hub WHERE g.node <> g.hub AND g.node NOT IN (SELECT path FROM h) GROUP BY node)"


@_add("feature_hubs", "SELECT path, label, out_degree FROM h", ("v_nodes", "v_imports"), f"{_INT}, {_HUBS}")
def feature_hubs(spark, sf_dir):
    return graph.feature_hubs(load(spark, sf_dir)).select("path", "label", "out_degree")


@_add("feature_assignment", "SELECT path, hub FROM f", ("v_nodes", "v_imports"), f"{_INT}, {_HUBS}, {_ASSIGN}")
def feature_assignment(spark, sf_dir):
    return graph.feature_assignment(load(spark, sf_dir))


@_add("feature_domains", "SELECT x.label, x.hub, CAST(count(f.path) AS BIGINT) AS n_files FROM (SELECT label, arg_max(path, node_seq) AS hub FROM h GROUP BY label) x LEFT JOIN f ON f.hub = x.hub GROUP BY x.label, x.hub", ("v_nodes", "v_imports"), f"{_INT}, {_HUBS}, {_ASSIGN}")
def feature_domains(spark, sf_dir):
    return graph.feature_domains(load(spark, sf_dir))[0].select("label", "hub", F.size("files").cast("bigint").alias("n_files"))


@_add("feature_unassigned", "SELECT path FROM v_nodes WHERE path NOT IN (SELECT path FROM f) AND path NOT IN (SELECT path FROM h)", ("v_nodes", "v_imports"), f"{_INT}, {_HUBS}, {_ASSIGN}")
def feature_unassigned(spark, sf_dir):
    return graph.feature_domains(load(spark, sf_dir))[1]


_ROLE = "CASE WHEN category = 'test' THEN 'test' WHEN category = 'config' THEN 'config' WHEN category = 'type-only' THEN 'types' " + " ".join(
    "WHEN " + " OR ".join(f"regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') = '{s[1:]}'" if s[0] == "=" else f"contains(path, '/{s}/') OR contains(path, '/{s}.')" for s in segments) + f" THEN '{name}'" for name, *segments in graph.ROLES
) + " ELSE 'other' END"


@_add("responsibility_roles", f"SELECT n.path, {_ROLE.replace('path', 'n.path')} AS role, CAST(coalesce(x.c, 0) AS BIGINT) AS n_exports, f.hub FROM v_nodes n LEFT JOIN f ON f.path = n.path LEFT JOIN (SELECT path, count(*) AS c FROM v_exports GROUP BY path) x ON x.path = n.path", ("v_nodes", "v_imports", "v_exports"), f"{_INT}, {_HUBS}, {_ASSIGN}")
def responsibility_roles(spark, sf_dir):
    return graph.responsibility(load(spark, sf_dir)).select("path", "role", F.size("exports").cast("bigint").alias("n_exports"), "hub")


_ENTRY = "category = 'barrel'"
_API = f"{_INT}, en AS (SELECT path FROM v_nodes WHERE {_ENTRY}), b AS (SELECT path AS node FROM en UNION SELECT e.dst FROM b JOIN e ON e.src = b.node)"


def _entries(g) -> DataFrame:
    return g.nodes.where(_ENTRY).select("path")


@_add("api_accessible_names", "SELECT DISTINCT name FROM (SELECT name FROM v_exports WHERE path IN (SELECT node FROM w) UNION ALL SELECT symbol FROM e WHERE type = 're-export' AND symbol IS NOT NULL AND src IN (SELECT node FROM w))", ("v_nodes", "v_imports", "v_exports"), f"{_INT}, w AS (SELECT path AS node FROM v_nodes WHERE {_ENTRY} UNION SELECT e.dst FROM w JOIN e ON e.src = w.node WHERE e.type = 're-export' AND e.symbol IS NULL)")
def api_accessible_names(spark, sf_dir):
    g = load(spark, sf_dir)
    return graph.accessible_names(g, _entries(g))


@_add("api_partitions", "SELECT path, CASE WHEN path IN (SELECT path FROM en) THEN 'entry' WHEN path IN (SELECT node FROM b) THEN CASE WHEN category <> 'test' THEN 'internal' ELSE 'reachable-test' END WHEN category = 'test' THEN 'test' ELSE 'unreachable' END AS part FROM v_nodes", ("v_nodes", "v_imports"), _API)
def api_partitions(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return graph.api_partitions(g, _entries(g))


_DEPTHS = "dp(path, depth) USING KEY (path) AS (SELECT path, 0 FROM v_nodes WHERE " + _ENTRY + " UNION SELECT e.dst, dp.depth + 1 FROM dp JOIN e ON e.src = dp.path WHERE NOT EXISTS (SELECT 1 FROM recurring.dp r WHERE r.path = e.dst))"
_ACCESSIBLE = f"w AS (SELECT path AS node FROM v_nodes WHERE {_ENTRY} UNION SELECT e.dst FROM w JOIN e ON e.src = w.node WHERE e.type = 're-export' AND e.symbol IS NULL), acc AS (SELECT DISTINCT name FROM (SELECT name FROM v_exports WHERE path IN (SELECT node FROM w) UNION ALL SELECT symbol FROM e WHERE type = 're-export' AND symbol IS NOT NULL AND src IN (SELECT node FROM w)))"
_DEFINED = (
    f"xs AS (SELECT x.name, x.path, x.signature, row(dp.depth, n.node_seq, x.exp_seq) AS o, x.signature <> '' AND n.category <> 'barrel' AS concrete FROM v_exports x JOIN dp ON dp.path = x.path JOIN v_nodes n ON n.path = x.path WHERE dp.path NOT IN (SELECT path FROM v_nodes WHERE {_ENTRY})), "
    "df AS (SELECT name, coalesce(arg_max(row(path, signature), o) FILTER (WHERE concrete), arg_min(row(path, signature), o)) AS d FROM xs GROUP BY name), "
    f"ow AS (SELECT x.name, arg_min(row(x.path, x.signature), row(n.node_seq, x.exp_seq)) AS d FROM v_exports x JOIN v_nodes n ON n.path = x.path WHERE n.{_ENTRY} GROUP BY x.name), "
    f"pb AS (SELECT acc.name, coalesce(df.d, ow.d) AS d FROM acc LEFT JOIN df ON df.name = acc.name LEFT JOIN ow ON ow.name = acc.name)"
)


@_add("api_public_exports", f"SELECT name, coalesce(d[1], (SELECT arg_min(path, node_seq) FROM v_nodes WHERE {_ENTRY})) AS defined_in, CASE WHEN d[2] LIKE 'interface %' THEN 'interface' WHEN d[2] LIKE 'class %' THEN 'class' WHEN d[2] LIKE 'const %' THEN 'const' ELSE 'unknown' END AS kind, d[2] AS signature FROM pb", ("v_nodes", "v_imports", "v_exports"), f"{_INT}, {_DEPTHS}, {_ACCESSIBLE}, {_DEFINED}")
def api_public_exports(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return graph.api_surface(g, _entries(g))[0].select("name", "defined_in", "kind", "signature")


_KINDS = "CASE WHEN x.signature LIKE 'interface %' THEN 'interface' WHEN x.signature LIKE 'class %' THEN 'class' ELSE 'type' END"
_TYPES = f"ty AS (SELECT x.path AS file, x.name, {_KINDS} AS kind, n.node_seq FROM v_exports x JOIN v_nodes n ON n.path = x.path WHERE n.type IN ('typescript', 'javascript') AND (n.category = 'type-only' OR {_KINDS} <> 'type'))"
_TEDGE = "te AS (SELECT e.src AS from_file, e.symbol AS to_type, e.dst AS to_file FROM e JOIN v_nodes n ON n.path = e.src JOIN ty ON ty.file = e.dst AND ty.name = e.symbol WHERE n.type IN ('typescript', 'javascript'))"


@_add("type_nodes", "SELECT file, name, kind FROM ty", ("v_nodes", "v_exports"), _TYPES)
def type_nodes(spark, sf_dir):
    return graph.type_nodes(load(spark, sf_dir)).select("file", "name", "kind")


@_add("type_edges", "SELECT * FROM te", ("v_nodes", "v_exports", "v_imports"), f"{_INT}, {_TYPES}, {_TEDGE}")
def type_edges(spark, sf_dir):
    return graph.type_edges(load(spark, sf_dir))


@_add("type_query", "SELECT DISTINCT 'uses' AS relation, te.to_file AS file, te.to_type AS name FROM te WHERE te.from_file = (SELECT arg_min(file, node_seq) FROM ty WHERE name = 's5') UNION SELECT 'used by', te.from_file, 's5' FROM te WHERE te.to_type = 's5' AND te.to_file = (SELECT arg_min(file, node_seq) FROM ty WHERE name = 's5') UNION SELECT 'is', arg_min(file, node_seq), 's5' FROM ty WHERE name = 's5' HAVING count(*) > 0", ("v_nodes", "v_exports", "v_imports"), f"{_INT}, {_TYPES}, {_TEDGE}")
def type_query(spark, sf_dir):
    target, used_by, uses = graph.query_type(load(spark, sf_dir), "s5")
    rows = lambda df, what: df.select(F.lit(what).alias("relation"), "file", "name")
    return rows(target, "is").union(rows(used_by.withColumn("name", F.lit("s5")), "used by")).union(rows(uses, "uses"))


@_add("call_graph_callers", "SELECT path, from_fn FROM v_calls WHERE to_fn = 's5'", ("v_calls",))
def call_graph_callers(spark, sf_dir):
    return graph.call_graph(load(spark, sf_dir), "s5")[1]


_LAST = "la AS (SELECT x.name, arg_max(x.path, n.node_seq) AS path FROM v_exports x JOIN v_nodes n ON n.path = x.path GROUP BY x.name), lc AS (SELECT c.from_fn, c.path, c.to_file, c.to_fn FROM v_calls c JOIN la ON la.name = c.from_fn AND la.path = c.path)"


@_add("call_graph_callees", f"SELECT to_file, to_fn FROM lc WHERE from_fn = {_TOP('lc', 'from_fn')}", ("v_calls", "v_exports", "v_nodes"), _LAST)
def call_graph_callees(spark, sf_dir):
    g = load(spark, sf_dir)
    g = g.with_tables(calls=cut(g.calls))
    last = g.exports.join(g.nodes.select("path", "node_seq"), "path").groupBy("name").agg(F.max_by("path", "node_seq").alias("path"))
    own = g.calls.join(last.withColumnRenamed("name", "from_fn"), ["from_fn", "path"], "left_semi")
    return graph.call_graph(g, _most(own, "from_fn"))[2]


@_add("find_symbol", "SELECT n.path, n.category, 'call' AS precision, c.path AS user, c.from_fn AS via FROM v_exports x JOIN v_nodes n ON n.path = x.path LEFT JOIN v_calls c ON c.to_fn = 's5' WHERE x.name = 's5' AND n.type IN ('typescript', 'javascript', 'go', 'python') UNION ALL SELECT n.path, n.category, 'file-level', e.src, NULL FROM v_exports x JOIN v_nodes n ON n.path = x.path LEFT JOIN e ON e.dst = n.path AND e.src <> e.dst WHERE x.name = 's5' AND n.type NOT IN ('typescript', 'javascript', 'go', 'python')", ("v_nodes", "v_exports", "v_calls", "v_imports"), _INT)
def find_symbol(spark, sf_dir):
    return graph.find_symbol(load(spark, sf_dir), "s5")


_CHANGED = "node_seq IN (8, 9, 16, 20)"
_STOP = f"{_INT}, {_HUBS}, b AS (SELECT path AS node, 0 AS walked FROM v_nodes WHERE {_CHANGED} UNION SELECT e.src, 1 FROM b JOIN e ON e.dst = b.node WHERE b.walked = 0 OR b.node NOT IN (SELECT path FROM h))"


def _changed(g) -> list[str]:
    return [r.path for r in g.nodes.where(_CHANGED).select("path").collect()]


@_add("propose_tags", f"SELECT DISTINCT tag FROM (SELECT label AS tag FROM h WHERE path IN (SELECT node FROM b) UNION ALL SELECT name FROM v_tags WHERE path NOT IN (SELECT path FROM h) AND path IN (SELECT node FROM b WHERE walked = 1) AND {_TESTS} AND path NOT IN (SELECT path FROM v_nodes WHERE {_CHANGED}))", ("v_nodes", "v_imports", "v_tags"), _STOP)
def propose_tags(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return graph.propose_tags(g, _changed(g))


@_add("affected_tests_hub_boundary", f"SELECT DISTINCT node AS path FROM b WHERE walked = 1 AND node NOT IN (SELECT path FROM h) AND node NOT IN (SELECT path FROM v_nodes WHERE {_CHANGED}) AND node IN (SELECT path FROM v_nodes WHERE category = 'test' UNION SELECT path FROM v_tags WHERE name = 'test')", ("v_nodes", "v_imports", "v_tags"), _STOP)
def affected_tests_hub_boundary(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return graph.affected_tests(g, _changed(g))


# ---- enrichment


@_add("churn_90d", "SELECT path, n AS commit_count_90d, author AS last_author, last AS last_commit_at FROM ch", ("v_commits",), f"ch AS ({_CH})")
def churn_90d(spark, sf_dir):
    return enrich.churn(load(spark, sf_dir))


@_add("export_usage", "SELECT path, a AS avg_export_usage, m AS max_export_usage FROM u", ("v_imports", "v_exports"), f"{_INT}, {_RATIO}, {_USE}")
def export_usage(spark, sf_dir):
    return enrich.export_usage(load(spark, sf_dir))


@_add("high_export_usage", "SELECT src AS path, max(ratio) AS max_export_usage, arg_max(dst, row(ratio, -edge_seq)) AS tightest FROM r GROUP BY src HAVING max(ratio) >= 0.8", ("v_imports", "v_exports"), f"{_INT}, {_RATIO}")
def high_export_usage(spark, sf_dir):
    return enrich.high_export_usage(load(spark, sf_dir))


@_add("tested_by", "SELECT b.path, string_agg(DISTINCT a.path, ' ' ORDER BY a.path) AS tests FROM e JOIN v_nodes a ON a.path = e.src JOIN v_nodes b ON b.path = e.dst WHERE a.category = 'test' AND b.category IN ('logic', 'barrel') GROUP BY b.path", ("v_nodes", "v_imports"), _INT)
def tested_by(spark, sf_dir):
    return enrich.tested_by(load(spark, sf_dir)).select("path", F.concat_ws(" ", "tested_by").alias("tests"))


@_add("doc_drift", "SELECT doc, path, stale FROM d", ("v_nodes", "v_imports", "v_commits"), f"{_INT}, ch AS ({_CH}), {_DOC}")
def doc_drift(spark, sf_dir):
    return enrich.doc_links(load(spark, sf_dir))


@_add("library_tags", "SELECT DISTINCT i.path, i.to_path AS name, 'library' AS kind FROM v_imports i WHERE is_external AND NOT EXISTS (SELECT 1 FROM v_tags t WHERE t.path = i.path AND t.name = i.to_path)", ("v_imports", "v_tags"))
def library_tags(spark, sf_dir):
    return enrich.library_tags(load(spark, sf_dir))


@_add("test_node_tags", f"SELECT DISTINCT path, name, kind FROM (SELECT e.src AS path, {_LABEL.replace('path', 'e.dst')} AS name, 'import' AS kind FROM e UNION ALL SELECT e.src, e.symbol, 'import' FROM e WHERE e.symbol IS NOT NULL UNION ALL SELECT e.src, t.name, 'comment-marker' FROM e JOIN v_tags t ON t.path = e.dst AND t.kind = 'comment-marker' JOIN v_nodes b ON b.path = e.dst WHERE b.category <> 'test') x WHERE path IN (SELECT path FROM v_nodes WHERE category = 'test') AND NOT EXISTS (SELECT 1 FROM v_tags t WHERE t.path = x.path AND t.name = x.name AND t.kind = x.kind)", ("v_nodes", "v_imports", "v_tags"), _INT)
def test_node_tags(spark, sf_dir):
    return enrich.test_tags(load(spark, sf_dir))


# ---- reports


@_add("category_histogram", "SELECT category, count(*) AS n FROM v_nodes GROUP BY category", ("v_nodes",))
def category_histogram(spark, sf_dir):
    return reports.category_histogram(load(spark, sf_dir))


@_add("language_coverage", "SELECT type, count(*) AS n, type IN ('typescript', 'javascript', 'python', 'go') AS call_edges, type IN ('typescript', 'javascript', 'python', 'go') AS complexity, type IN ('typescript', 'javascript', 'python', 'go', 'coffeescript', 'livescript', 'lua', 'gherkin') AS tags FROM v_nodes GROUP BY type", ("v_nodes",))
def language_coverage(spark, sf_dir):
    return reports.language_coverage(load(spark, sf_dir))


@_add("tag_histogram", "SELECT name, count(*) AS n FROM v_tags GROUP BY name", ("v_tags",))
def tag_histogram(spark, sf_dir):
    return reports.tag_histogram(load(spark, sf_dir))


@_add("complex_functions", "SELECT path, name, complexity, cognitive FROM v_functions WHERE complexity >= 10 ORDER BY complexity DESC, path, name LIMIT 20", ("v_functions",))
def complex_functions(spark, sf_dir):
    return reports.complex_functions(load(spark, sf_dir))


@_add("risk_hotspots", "SELECT f.path, f.name, f.complexity, f.cognitive, n.coverage_pct, CAST(ch.n AS BIGINT) AS commit_count_90d FROM v_functions f JOIN v_nodes n ON n.path = f.path LEFT JOIN ch ON ch.path = f.path WHERE f.complexity >= 10 AND n.coverage_pct <= 50 AND (coalesce(ch.n, 0) >= 1 OR (SELECT coalesce(max(n), 0) FROM ch) = 0) ORDER BY f.complexity DESC, f.path, f.name LIMIT 20", ("v_functions", "v_nodes", "v_commits"), f"ch AS ({_CH})")
def risk_hotspots(spark, sf_dir):
    return reports.risk_hotspots(load(spark, sf_dir))


@_add("uncovered", "SELECT path, coverage_pct FROM v_nodes WHERE coverage_pct < 80 AND category NOT IN ('test', 'config')", ("v_nodes",))
def uncovered(spark, sf_dir):
    return reports.uncovered(load(spark, sf_dir))


@_add("data_availability", "SELECT (SELECT count(coverage_pct) > 0 FROM v_nodes) AS has_coverage, (SELECT count(*) > 0 FROM v_commits) AS has_churn", ("v_nodes", "v_commits"))
def data_availability(spark, sf_dir):
    return reports.availability(load(spark, sf_dir))


@_add("workspace_deps", "SELECT DISTINCT n.package, i.workspace_package AS depends_on FROM v_imports i JOIN v_nodes n ON n.path = i.path WHERE i.is_workspace", ("v_nodes", "v_imports"))
def workspace_deps(spark, sf_dir):
    return reports.package_dependencies(load(spark, sf_dir))


@_add("workspace_summary", "SELECT n.package, n.files, coalesce(d.deps, '') AS depends_on FROM (SELECT package, count(*) AS files FROM v_nodes GROUP BY package) n LEFT JOIN (SELECT a.package, string_agg(DISTINCT i.workspace_package, ' ' ORDER BY i.workspace_package) AS deps FROM v_imports i JOIN v_nodes a ON a.path = i.path WHERE i.is_workspace GROUP BY a.package) d ON d.package = n.package", ("v_nodes", "v_imports"))
def workspace_summary(spark, sf_dir):
    return reports.workspace_summary(load(spark, sf_dir)).select("package", "files", F.concat_ws(" ", "depends_on").alias("depends_on"))


@_add("workspace_affected", f"SELECT node AS path FROM b WHERE node <> {_IN} UNION SELECT i.path FROM v_imports i JOIN v_nodes n ON n.path = i.path WHERE i.is_workspace AND i.workspace_package = (SELECT package FROM v_nodes WHERE path = {_IN}) AND n.package <> i.workspace_package", ("v_nodes", "v_imports"), f"{_INT}, ie AS (SELECT e.src, e.dst FROM e JOIN v_nodes a ON a.path = e.src JOIN v_nodes b ON b.path = e.dst WHERE a.package = b.package), b AS (SELECT {_IN} AS node UNION SELECT ie.src FROM b JOIN ie ON ie.dst = b.node)")
def workspace_affected(spark, sf_dir):
    g = _kept(spark, sf_dir)
    return reports.affected_across_packages(g, _imported(g))


@_add("package_owner", "SELECT n.path, lower(n.package) AS name FROM v_nodes n", ("v_nodes",))
def package_owner(spark, sf_dir):
    g = load(spark, sf_dir)
    packages = g.nodes.groupBy(F.col("package").alias("name")).agg(F.min("node_seq").alias("pkg_seq")).select("pkg_seq", "name", F.concat(F.lit("src/"), "name").alias("relative_root"))
    return reports.owner_packages(g, packages)


@_add("mermaid_lines", "SELECT DISTINCT concat('  \"', path, '\" --> \"', to_path, '\"') AS line FROM v_imports", ("v_imports",))
def mermaid_lines(spark, sf_dir):
    return reports.mermaid_lines(load(spark, sf_dir))


@_add("json_graph", "SELECT n.path, n.type, n.category, n.size, coalesce((SELECT string_agg(to_path, ' ' ORDER BY edge_seq) FROM v_imports i WHERE i.path = n.path), '') AS imports, coalesce((SELECT string_agg(name, ' ' ORDER BY exp_seq) FROM v_exports x WHERE x.path = n.path), '') AS exports, coalesce((SELECT string_agg(concat(name, ':', kind), ' ' ORDER BY name, kind) FROM v_tags t WHERE t.path = n.path), '') AS tags FROM v_nodes n", ("v_nodes", "v_imports", "v_exports", "v_tags"))
def json_graph(spark, sf_dir):
    """The JSON lines, read back."""
    schema = "path STRING, type STRING, category STRING, size BIGINT, imports ARRAY<STRUCT<to_path: STRING>>, exports ARRAY<STRUCT<name: STRING>>, tags ARRAY<STRUCT<name: STRING, kind: STRING>>"
    j = reports.to_json_lines(load(spark, sf_dir)).select(F.from_json("json", schema).alias("j")).select("j.*")
    return j.select("path", "type", "category", "size", F.concat_ws(" ", "imports.to_path").alias("imports"), F.concat_ws(" ", "exports.name").alias("exports"), F.concat_ws(" ", F.transform("tags", lambda t: F.concat(t["name"], F.lit(":"), t["kind"]))).alias("tags"))


@_add("json_document", "SELECT 'node' AS part, count(*) AS n FROM v_nodes UNION ALL SELECT 'language', count(DISTINCT type) FROM v_nodes", ("v_nodes",))
def json_document(spark, sf_dir):
    return reports.document(load(spark, sf_dir), slim_nodes=True).where("part <> 'cycle'").groupBy("part").agg(F.count("*").alias("n"))


@_add("page_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages")
def page_links(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))


_CODE = "CASE type WHEN 'python' THEN concat('from .m', CAST(node_seq % 7 AS STRING), ' import f\\nimport os\\n') WHEN 'go' THEN concat('package a\\nimport \"p', CAST(node_seq % 7 AS STRING), '\"\\n') WHEN 'css' THEN concat('@import \"m', CAST(node_seq % 7 AS STRING), '.css\";') WHEN 'lua' THEN concat('local m = require(\"m', CAST(node_seq % 7 AS STRING), '\")') WHEN 'markdown' THEN concat('[m](./m', CAST(node_seq % 7 AS STRING), '.md)') ELSE concat('import { f } from \"./m', CAST(node_seq % 7 AS STRING), '\";\\nexport * from \"./all\";') END"
_SPEC = "CASE type WHEN 'python' THEN './m' WHEN 'go' THEN 'p' WHEN 'css' THEN 'm' WHEN 'lua' THEN 'm' ELSE './m' END || CAST(node_seq % 7 AS STRING) || CASE type WHEN 'css' THEN '.css' WHEN 'markdown' THEN '.md' ELSE '' END"


@_add("parsed_imports", f"SELECT path, {_SPEC} AS specifier, CASE WHEN type = 'lua' THEN 'require' ELSE 'static' END AS import_type FROM v_nodes UNION ALL SELECT path, 'os', 'static' FROM v_nodes WHERE type = 'python' UNION ALL SELECT path, './all', 're-export' FROM v_nodes WHERE type IN ('typescript', 'javascript')", ("v_nodes",))
def parsed_imports(spark, sf_dir):
    """Source text made up for every file, parsed by its language's parser."""
    files = load(spark, sf_dir).nodes.select("path", "mtime", "size", F.expr(_CODE).alias("content"))
    return parse_table(files).select("path", F.explode("imports").alias("i")).select("path", "i.specifier", F.col("i.type").alias("import_type"))


_N = "CAST(node_seq AS STRING)"
_BODY = (
    f"CASE type WHEN 'python' THEN concat('# @tag t', CAST(node_seq % 5 AS STRING), '\\nfrom .m import g\\ndef f', {_N}, '(a):\\n    if a and a > 1:\\n        return g(a)\\n    return 2\\n') "
    f"WHEN 'go' THEN concat('// @tag t', CAST(node_seq % 5 AS STRING), '\\npackage a\\nfunc F', {_N}, '(a int) int {{\\n\\tif a > 0 && a < 9 {{\\n\\t\\treturn 1\\n\\t}}\\n\\treturn 2\\n}}\\n') "
    f"WHEN 'typescript' THEN concat('// @tag t', CAST(node_seq % 5 AS STRING), '\\nimport {{ g }} from \"./m\";\\nexport function f', {_N}, '(a: number) {{\\n  if (a && a > 1) {{ return g(a); }}\\n  return 2;\\n}}\\n') "
    f"WHEN 'javascript' THEN concat('// @tag t', CAST(node_seq % 5 AS STRING), '\\nimport {{ g }} from \"./m\";\\nexport const f', {_N}, ' = (a) => {{\\n  if (a && a > 1) {{ return g(a); }}\\n  return 2;\\n}};\\n') "
    "ELSE '' END"
).replace("{{", "{").replace("}}", "}")
_CODED = "type IN ('python', 'go', 'typescript', 'javascript')"
_FN = f"concat(CASE type WHEN 'go' THEN 'F' ELSE 'f' END, {_N})"


def _bodies(spark, sf_dir) -> DataFrame:
    """A file made up for every node, parsed by its language's parser."""
    return parse_table(load(spark, sf_dir).nodes.select("path", "mtime", "size", F.expr(_BODY).alias("content")))


@_add("parsed_functions", f"SELECT path, {_FN} AS name, 3 AS complexity, 2 AS cognitive FROM v_nodes WHERE {_CODED}", ("v_nodes",))
def parsed_functions(spark, sf_dir):
    return _bodies(spark, sf_dir).select("path", F.explode("functions").alias("f")).select("path", "f.name", "f.complexity", "f.cognitive")


@_add("parsed_exports", f"SELECT path, {_FN} AS name FROM v_nodes WHERE {_CODED}", ("v_nodes",))
def parsed_exports(spark, sf_dir):
    return _bodies(spark, sf_dir).select("path", F.explode("exports").alias("x")).select("path", "x.name")


@_add("parsed_tags", f"SELECT path, concat('t', CAST(node_seq % 5 AS STRING)) AS name, 'comment-marker' AS kind FROM v_nodes WHERE {_CODED} UNION ALL SELECT path, {_FN}, 'function' FROM v_nodes WHERE type IN ('typescript', 'javascript')", ("v_nodes",))
def parsed_tags(spark, sf_dir):
    return _bodies(spark, sf_dir).select("path", F.explode("tags").alias("t")).select("path", "t.name", "t.kind")


@_add("parsed_calls", f"SELECT path, {_FN} AS from_fn, 'g' AS to_fn, './m' AS specifier FROM v_nodes WHERE {_CODED} AND type <> 'go'", ("v_nodes",))
def parsed_calls(spark, sf_dir):
    return _bodies(spark, sf_dir).select("path", F.explode("calls").alias("c")).select("path", "c.from_fn", "c.to_fn", "c.specifier")


# ---- builds: a monorepo written from the graph, a package a folder, and built again

_SLUG = "replace(package, ' ', '-')"


def _monorepo(g):
    slug = F.expr(_SLUG)
    own = g.nodes.select("path", "node_seq", slug.alias("pkg"))
    to = own.select(F.col("path").alias("dst"), F.col("node_seq").alias("to_seq"), F.col("pkg").alias("to_pkg"))
    line = F.when(F.col("pkg") == F.col("to_pkg"), F.concat(F.lit('import { x } from "./f'), F.col("to_seq").cast("string"), F.lit('";'))).otherwise(F.concat(F.lit('import { x } from "@o/'), F.col("to_pkg"), F.lit('/src/f'), F.col("to_seq").cast("string"), F.lit('";')))
    edges = g.internal().select(F.col("src").alias("path"), "dst").join(own, "path").join(to, "dst")
    text = edges.groupBy("node_seq").agg(F.concat_ws("\n", F.array_sort(F.collect_set(line))).alias("content"))
    files = own.join(text, "node_seq", "left").select(F.concat(F.lit("packages/"), "pkg", F.lit("/src/f"), F.col("node_seq").cast("string"), F.lit(".ts")).alias("path"), F.lit(1.0).alias("mtime"), F.lit(1).cast("bigint").alias("size"), F.concat(F.coalesce("content", F.lit("")), F.lit("\nexport const x = 1;\n")).alias("content"))
    packages = own.groupBy("pkg").agg(F.min("node_seq").alias("s")).select(F.col("s").cast("int").alias("pkg_seq"), F.concat(F.lit("@o/"), "pkg").alias("name"), F.concat(F.lit("packages/"), "pkg").alias("relative_root"), F.array(F.concat(F.lit("packages/"), "pkg", F.lit("/src/f"), F.col("s").cast("string"), F.lit(".ts"))).alias("entry_points"))
    return build(cut(files), options=BuildOptions(packages=cut(packages)))


_MONO = f"{_INT}, mo AS (SELECT path, concat('packages/', {_SLUG}, '/src/f', CAST(node_seq AS STRING), '.ts') AS file, concat('@o/', {_SLUG}) AS pkg FROM v_nodes), me AS (SELECT DISTINCT a.file, a.pkg, b.file AS to_file, b.pkg AS to_pkg FROM e JOIN mo a ON a.path = e.src JOIN mo b ON b.path = e.dst)"


@_add("built_imports", "SELECT file AS path, to_file AS to_path, pkg <> to_pkg AS is_workspace, CASE WHEN pkg <> to_pkg THEN to_pkg END AS workspace_package FROM me", ("v_nodes", "v_imports"), _MONO)
def built_imports(spark, sf_dir):
    return _monorepo(load(spark, sf_dir)).imports.where("not is_external").select("path", "to_path", "is_workspace", "workspace_package")


@_add("built_workspace_summary", "SELECT m.pkg AS package, m.n AS files, coalesce(d.deps, '') AS depends_on FROM (SELECT pkg, count(*) AS n FROM mo GROUP BY pkg) m LEFT JOIN (SELECT pkg, string_agg(DISTINCT to_pkg, ' ' ORDER BY to_pkg) AS deps FROM me WHERE pkg <> to_pkg GROUP BY pkg) d ON d.pkg = m.pkg", ("v_nodes", "v_imports"), _MONO)
def built_workspace_summary(spark, sf_dir):
    return reports.workspace_summary(_monorepo(load(spark, sf_dir))).select("package", "files", F.concat_ws(" ", "depends_on").alias("depends_on"))


@_add("built_workspace_affected", f"SELECT node AS path FROM lb WHERE node <> (SELECT file FROM mo WHERE path = {_IN}) UNION SELECT file FROM me WHERE pkg <> to_pkg AND to_pkg = (SELECT pkg FROM mo WHERE path = {_IN})", ("v_nodes", "v_imports"), f"{_MONO}, lb AS (SELECT file AS node FROM mo WHERE path = {_IN} UNION SELECT me.file FROM lb JOIN me ON me.to_file = lb.node WHERE me.pkg = me.to_pkg)")
def built_workspace_affected(spark, sf_dir):
    g = _kept(spark, sf_dir)
    row = g.nodes.where(F.col("path") == _imported(g)).select(F.expr(_SLUG).alias("pkg"), "node_seq").first()
    return reports.affected_across_packages(_monorepo(g), f"packages/{row.pkg}/src/f{row.node_seq}.ts")


@_add("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """The stream's event-time windows, over the table."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("value", F.round(F.col("value") * 100).cast("bigint"))
    return watch.user_activity(events).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("value").alias("cents"))


# ---- duplicates


_RULE = "concat('/* rules */\n.c', CAST(node_seq AS STRING), ' {\n  margin: ', CAST(size AS STRING), 'px;\n  color: c', CAST(node_seq % 13 AS STRING), ';\n  top: 0\n}\n')"
_SIGNED = "r AS (SELECT path AS file, concat('margin:', CAST(size AS STRING), 'px;color:c', CAST(node_seq % 13 AS STRING), ';top:0') AS signature FROM v_nodes WHERE type = 'css')"


def _rules(spark, sf_dir) -> DataFrame:
    """A style sheet made up for every css file, cut into its rules."""
    return block_table(load(spark, sf_dir).nodes.where("type = 'css'").select("path", F.expr(_RULE).alias("content")))


@_add("style_block_duplicates", "SELECT 5 AS lines, a.signature, a.file AS file_a, b.file AS file_b FROM r a JOIN r b ON a.signature = b.signature AND a.file < b.file", ("v_nodes",), _SIGNED)
def style_block_duplicates(spark, sf_dir):
    return duplicates.style_duplicates(_rules(spark, sf_dir), 3).select("lines", "signature", "file_a", "file_b")


@_add("style_block_groups", "SELECT signature, count(*) AS copies, string_agg(file, ' ' ORDER BY file) AS files FROM r GROUP BY signature HAVING count(*) > 1", ("v_nodes",), _SIGNED)
def style_block_groups(spark, sf_dir):
    return duplicates.style_groups(_rules(spark, sf_dir), 3).select("signature", "copies", F.concat_ws(" ", "occurrences.file").alias("files"))


@_add("token_duplicates")
def token_duplicates(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return duplicates.token_duplicates(duplicates.line_tokens(docs), width=15, min_lines=1, limit=50)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

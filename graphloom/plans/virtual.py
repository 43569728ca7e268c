"""A code graph projected from the driver's star schema, by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.plans.model import CodeGraph

_KIND = "CASE p_partkey % 8 WHEN 0 THEN '{0}' WHEN 1 THEN '{0}' WHEN 2 THEN '{1}' WHEN 3 THEN '{2}' WHEN 4 THEN '{3}' WHEN 5 THEN '{4}' WHEN 6 THEN '{5}' ELSE '{6}' END"
_PATH = "concat('src/', lower(p_type), '/', replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING), " + _KIND.format(".ts", ".js", ".py", ".go", ".css", ".md", ".lua") + ")"
_STEP_ORDER = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"

#: name -> (SQL, what it reads); driver tables in braces
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_fx": ("SELECT l_partkey AS node_seq, concat('f', CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS name, CAST(MAX(l_linenumber * 2) AS INT) AS complexity, CAST(MAX(CAST(l_quantity AS INT)) AS INT) AS cognitive FROM {lineitem} WHERE l_discount >= 0.09 GROUP BY 1, 2", ()),
    "v_cx": ("SELECT node_seq, CAST(MAX(complexity) AS INT) AS complexity, CAST(MAX(cognitive) AS INT) AS cognitive FROM v_fx GROUP BY node_seq", ("v_fx",)),
    "v_nodes": (
        f"SELECT CAST(p_partkey AS BIGINT) AS node_seq, {_PATH} AS path, {_KIND.format('typescript', 'javascript', 'python', 'go', 'css', 'markdown', 'lua')} AS type, "
        "CASE WHEN p_partkey % 8 = 5 THEN 'ui' WHEN p_partkey % 8 = 6 THEN 'other' WHEN p_partkey % 11 = 0 THEN 'test' WHEN p_partkey % 11 = 1 THEN 'barrel' WHEN p_partkey % 11 = 2 THEN 'type-only' WHEN p_partkey % 11 = 3 THEN 'config' ELSE 'logic' END AS category, "
        "CAST(p_partkey AS DOUBLE) AS mtime, CAST(p_size AS BIGINT) AS size, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS description, CAST(CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE p_partkey % 101 END AS DOUBLE) AS coverage_pct, "
        "c.complexity AS complexity, c.cognitive AS cognitive, lower(p_type) AS package FROM {part} LEFT JOIN v_cx c ON c.node_seq = p_partkey",
        ("v_cx",),
    ),
    "v_steps": (
        f"SELECT l_orderkey, l_partkey AS src_seq, l_quantity, l_discount, l_returnflag, l_suppkey, lead(l_partkey) OVER ({_STEP_ORDER}) AS dst_seq, lead(l_suppkey) OVER ({_STEP_ORDER}) AS dst_supp FROM {{lineitem}}",
        (),
    ),
    "v_edges": (
        "SELECT src_seq, dst_seq, MIN(concat('s', CAST(dst_supp AS STRING))) AS symbol, MIN(CASE l_returnflag WHEN 'A' THEN 'static' WHEN 'N' THEN 're-export' ELSE 'dynamic' END) AS type, dst_seq % 17 = 0 AS is_external "
        "FROM v_steps WHERE dst_seq IS NOT NULL AND dst_seq <> src_seq AND l_quantity >= 48 GROUP BY src_seq, dst_seq",
        ("v_steps",),
    ),
    # symbol is null for a whole-module import: every seventh target
    "v_imports": (
        "SELECT a.path AS path, CAST(row_number() OVER (PARTITION BY a.path ORDER BY e.dst_seq) - 1 AS INT) AS edge_seq, CASE WHEN e.is_external THEN concat('lib-', CAST(e.dst_seq % 50 AS STRING)) ELSE b.path END AS to_path, "
        "e.type AS type, CASE WHEN e.dst_seq % 7 = 0 THEN NULL ELSE e.symbol END AS symbol, e.is_external AS is_external, NOT e.is_external AND a.package <> b.package AS is_workspace, b.package AS workspace_package "
        "FROM v_edges e JOIN v_nodes a ON a.node_seq = e.src_seq JOIN v_nodes b ON b.node_seq = e.dst_seq",
        ("v_edges", "v_nodes"),
    ),
    "v_exports": (
        "SELECT n.path AS path, CAST(row_number() OVER (PARTITION BY n.path ORDER BY x.supp) - 1 AS INT) AS exp_seq, concat('s', CAST(x.supp AS STRING)) AS name, CASE WHEN x.supp % 4 = 0 THEN 'interface I' WHEN x.supp % 4 = 1 THEN 'class C' WHEN x.supp % 4 = 2 THEN 'const c' END AS signature "
        "FROM (SELECT DISTINCT l_partkey AS node_seq, l_suppkey AS supp FROM {lineitem} WHERE l_quantity <= 24) x JOIN v_nodes n ON n.node_seq = x.node_seq",
        ("v_nodes",),
    ),
    "v_functions": ("SELECT n.path AS path, f.name AS name, f.complexity AS complexity, f.cognitive AS cognitive FROM v_fx f JOIN v_nodes n ON n.node_seq = f.node_seq", ("v_fx", "v_nodes")),
    "v_tags": (
        "SELECT n.path AS path, x.name AS name, x.kind AS kind FROM (SELECT DISTINCT l.l_partkey AS node_seq, lower(n.n_name) AS name, CASE l.l_linestatus WHEN 'O' THEN 'comment-marker' ELSE 'import' END AS kind "
        "FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN {nation} n ON n.n_nationkey = s.s_nationkey WHERE l.l_quantity <= 3) x JOIN v_nodes n ON n.node_seq = x.node_seq",
        ("v_nodes",),
    ),
    "v_calls": (
        "SELECT DISTINCT a.path AS path, concat('s', CAST(l_suppkey AS STRING)) AS from_fn, concat('s', CAST(dst_supp AS STRING)) AS to_fn, b.path AS to_file "
        "FROM v_steps JOIN v_nodes a ON a.node_seq = src_seq JOIN v_nodes b ON b.node_seq = dst_seq WHERE dst_seq IS NOT NULL AND dst_seq <> src_seq AND l_discount = 0.0",
        ("v_steps", "v_nodes"),
    ),
    "v_commits": ("SELECT n.path AS path, concat('a', CAST(o.o_custkey % 50 AS STRING)) AS author, o.o_orderdate AS ts, CAST(o.o_orderkey AS BIGINT) AS log_seq FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN v_nodes n ON n.node_seq = l.l_partkey", ("v_nodes",)),
}
TABLES = ("part", "lineitem", "supplier", "nation", "orders")
#: Joins with v_nodes, which Spark would broadcast by the size of the compressed part file, when the paths made from it are some 30 times that.
MERGED = {"v_imports": "a, b", "v_exports": "n", "v_functions": "n", "v_tags": "n", "v_calls": "a, b", "v_commits": "n"}


def _needed(names, found: dict) -> dict:
    for name in names:
        sql, reads = VIEWS[name]
        _needed(reads, found)
        found.setdefault(name, sql)
    return found


def with_views(*names: str) -> str:
    """`WITH v_... AS (...), ...` of the views and what they read, for the oracle."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({sql.format(**{t: t for t in TABLES})})" for n, sql in _needed(names, {}).items())


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    merged = lambda n, sql: sql.replace("SELECT", f"SELECT /*+ MERGE({MERGED[n]}) */", 1) if n in MERGED else sql
    ctes = ", ".join(f"{n} AS ({merged(n, sql)})" for n, sql in _needed([name], {}).items())
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}", **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in ctes})


def load(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The graph over the driver tables; nothing is read before it is used.

    Nodes are joined by merging: they are never sent to the driver, however small their file is.
    """
    seq = lambda df, by, name: df.withColumn(name, F.lit(0)) if by is None else df
    imports = view(spark, sf_dir, "v_imports").select("path", "edge_seq", "to_path", F.col("to_path").alias("raw_specifier"), "type", F.lit(False).alias("is_style"), F.when(F.col("symbol").isNotNull(), F.array("symbol")).alias("symbols"), "is_external", F.lit(None).cast("string").alias("version"), "is_workspace", "workspace_package")
    exports = view(spark, sf_dir, "v_exports").select("path", "exp_seq", "name", F.lit(None).cast("string").alias("doc"), F.lit(None).cast("array<string>").alias("flags"), "signature")
    tags = seq(view(spark, sf_dir, "v_tags"), None, "tag_seq")
    functions = view(spark, sf_dir, "v_functions").select("path", F.lit(0).alias("fn_seq"), "name", F.lit(0).alias("line"), "complexity", "cognitive")
    calls = seq(view(spark, sf_dir, "v_calls"), None, "call_seq")
    return CodeGraph(view(spark, sf_dir, "v_nodes").hint("merge"), imports, exports, tags, functions, calls, view(spark, sf_dir, "v_commits"))

"""Facts added to files by joins: coverage, churn, tests, documents, export usage, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans.model import CodeGraph


def round4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def package_of(specifier: Column) -> Column:
    """`@scope/name` of a scoped specifier, else its first segment."""
    parts = F.split(specifier, "/")
    return F.when(specifier.startswith("@"), F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.element_at(parts, 1))


def churn(graph: CodeGraph, as_of: Column | None = None, days: int = 90) -> DataFrame:
    """(path, commit_count_90d, last_author, last_commit_at): author and count of the window, newest commit of all.

    `as_of` is the end of the window, the newest commit of all by default; a file whose commits are all
    older has count 0 and no author.
    """
    commits = graph.commits
    end = commits.agg(F.max("ts").alias("end")) if as_of is None else commits.sparkSession.range(1).select(as_of.alias("end"))
    recent = F.col("ts") >= F.col("end") - F.expr(f"INTERVAL {days} DAYS")
    rows = commits.crossJoin(F.broadcast(end))  # one row
    return rows.groupBy("path").agg(F.count_if(recent).alias("commit_count_90d"), F.max_by("author", F.when(recent, F.struct("ts", "log_seq", "author"))).alias("last_author"), F.max("ts").alias("last_commit_at"))


def with_coverage(graph: CodeGraph, coverage: DataFrame) -> CodeGraph:
    """Nodes with coverage_pct from (path, pct)."""
    return graph.with_tables(nodes=graph.nodes.drop("coverage_pct").join(coverage.groupBy("path").agg(F.max("pct").alias("coverage_pct")), "path", "left"))


def _targets(graph: CodeGraph) -> DataFrame:
    """Imports with src and dst facts of internal edges."""
    a = graph.nodes.select(F.col("path").alias("src"), F.col("category").alias("src_category"), F.col("type").alias("src_type"))
    b = graph.nodes.select(F.col("path").alias("dst"), F.col("category").alias("dst_category"))
    return graph.internal().join(a, "src").join(b, "dst")


def tested_by(graph: CodeGraph) -> DataFrame:
    """(path, tested_by): tests that import a logic or barrel file, sorted."""
    rows = _targets(graph).where("src_category = 'test' and dst_category in ('logic', 'barrel')")
    return rows.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("tested_by"))


def doc_links(graph: CodeGraph) -> DataFrame:
    """(doc, path, stale): markdown files and what they refer to; stale if a logic file's newest commit is newer."""
    at = churn(graph).select("path", "last_commit_at") if graph.commits is not None else graph.nodes.select("path", F.lit(None).cast("timestamp").alias("last_commit_at"))
    doc_at, code_at = at.toDF("src", "doc_at"), at.toDF("dst", "code_at")
    rows = _targets(graph).where("src_type = 'markdown' and src <> dst").select("src", "dst", "dst_category").distinct()
    rows = rows.join(doc_at, "src", "left").join(code_at, "dst", "left")
    stale = (F.col("dst_category") == "logic") & F.col("code_at").isNotNull() & (F.col("doc_at").isNull() | (F.col("code_at") > F.col("doc_at")))
    return rows.select(F.col("src").alias("doc"), F.col("dst").alias("path"), stale.alias("stale"))


def edge_usage(graph: CodeGraph) -> DataFrame:
    """(src, dst, edge_seq, ratio): share of the target's exports that an import uses.

    Whole-module and wildcard imports use all; side-effect imports without symbols and targets without
    exports are left out.
    """
    exports = graph.exports.groupBy("path").agg(F.count("*").alias("n")).withColumnRenamed("path", "dst")
    rows = graph.internal().where("not (symbols is null and type = 'side-effect')").join(exports, "dst")
    share = F.when(F.col("symbols").isNull() | F.array_contains("symbols", "*"), F.lit(1.0)).otherwise(F.size("symbols").cast("double") / F.col("n").cast("double"))
    return rows.select("src", "dst", "edge_seq", round4(F.least(F.lit(1.0), share)).alias("ratio"))


def export_usage(graph: CodeGraph) -> DataFrame:
    """(path, avg_export_usage, max_export_usage) over a file's imports, rounded to four places at both levels."""
    # whole ten-thousandths, so that the order of the sum can't show
    points = F.sum(F.round(F.col("ratio") * 10000).cast("bigint")).cast("double")
    return edge_usage(graph).groupBy(F.col("src").alias("path")).agg((F.floor(points / F.count("*") + 0.5) / 10000).alias("avg_export_usage"), F.max("ratio").alias("max_export_usage"))


def high_export_usage(graph: CodeGraph, threshold: float = 0.8) -> DataFrame:
    """(path, max_export_usage, tightest): files whose tightest import reaches the threshold, first edge on ties."""
    rows = edge_usage(graph).groupBy(F.col("src").alias("path")).agg(F.max("ratio").alias("max_export_usage"), F.max_by("dst", F.struct(F.col("ratio"), -F.col("edge_seq"))).alias("tightest"))
    return rows.where(F.col("max_export_usage") >= threshold).orderBy(F.desc("max_export_usage"), "path")


def library_tags(graph: CodeGraph) -> DataFrame:
    """(path, name, kind): the packages a file imports as tags, unless it has a tag of that name."""
    names = graph.imports.where("is_external").join(graph.nodes.select("path"), "path", "left_semi").select("path", package_of(F.col("raw_specifier")).alias("name")).where("name <> ''").distinct()
    return names.join(graph.tags.select("path", "name").distinct(), ["path", "name"], "left_anti").withColumn("kind", F.lit("library"))


def test_tags(graph: CodeGraph) -> DataFrame:
    """(path, name, kind) that tests get from what they import: its file name, the symbols, its comment markers."""
    rows = _targets(graph).where("src_category = 'test'")
    base = F.element_at(F.split("dst", "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), r"\.(test|spec)$", "")
    files = rows.select(F.col("src").alias("path"), stem.alias("name"), F.lit("import").alias("kind"))
    symbols = rows.where("symbols is not null and not array_contains(symbols, '*')").select(F.col("src").alias("path"), F.explode("symbols").alias("name"), F.lit("import").alias("kind"))
    marks = graph.tags.where("kind = 'comment-marker'").select(F.col("path").alias("dst"), "name")
    passed = rows.where("dst_category <> 'test'").join(marks, "dst").select(F.col("src").alias("path"), "name", F.lit("comment-marker").alias("kind"))
    found = files.union(symbols).union(passed).where("name <> ''").distinct()
    return found.join(graph.tags.select("path", "name", "kind"), ["path", "name", "kind"], "left_anti")


def enrich(graph: CodeGraph) -> CodeGraph:
    """Nodes with all derived columns and tags with the derived ones; base tables are never changed, so nothing goes stale."""
    links = doc_links(graph)
    nodes = graph.nodes.drop("commit_count_90d", "last_author", "last_commit_at", "avg_export_usage", "max_export_usage", "tested_by", "documented_by", "stale_for")
    nodes = nodes.join(export_usage(graph), "path", "left").join(tested_by(graph), "path", "left")
    nodes = nodes.join(links.groupBy("path").agg(F.array_sort(F.collect_set("doc")).alias("documented_by")), "path", "left")
    nodes = nodes.join(links.where("stale").groupBy(F.col("doc").alias("path")).agg(F.array_sort(F.collect_set("path")).alias("stale_for")), "path", "left")
    nodes = nodes.join(churn(graph), "path", "left") if graph.commits is not None else nodes.withColumns({"commit_count_90d": F.lit(None).cast("bigint"), "last_author": F.lit(None).cast("string"), "last_commit_at": F.lit(None).cast("timestamp")})
    tags = graph.tags.select("path", "name", "kind").unionByName(library_tags(graph)).unionByName(test_tags(graph))
    return graph.with_tables(nodes=nodes, tags=tags)

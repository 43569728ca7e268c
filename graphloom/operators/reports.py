"""Counts, rankings, workspace questions and text output over a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.enrich import churn
from graphloom.operators.graph import CALL_TYPES, cycles, unused_files
from graphloom.plans.model import CodeGraph
from graphloom.plans.traverse import reach

COMPLEXITY_TYPES = tuple("go javascript python typescript".split())
TAG_TYPES = tuple("coffeescript gherkin go javascript livescript lua python typescript".split())
TEST_NAMES = tuple("-spec. .spec. -test. .test.".split())


def category_histogram(graph: CodeGraph) -> DataFrame:
    return graph.nodes.groupBy("category").agg(F.count("*").alias("n"))


def language_coverage(graph: CodeGraph) -> DataFrame:
    """(type, n, call_edges, complexity, tags) by falling count."""
    t = F.col("type")
    return graph.nodes.groupBy("type").agg(F.count("*").alias("n")).select("type", "n", t.isin(*CALL_TYPES).alias("call_edges"), t.isin(*COMPLEXITY_TYPES).alias("complexity"), t.isin(*TAG_TYPES).alias("tags")).orderBy(F.desc("n"), "type")


def tag_histogram(graph: CodeGraph) -> DataFrame:
    """(name, n): occurrences over all kinds, by falling count."""
    return graph.tags.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")


def complex_functions(graph: CodeGraph, metric: str = "complexity", threshold: int = 10, limit: int = 20) -> DataFrame:
    """(path, name, complexity, cognitive): the `limit` functions highest in a metric, from the threshold on."""
    return graph.functions.where(F.col(metric) >= threshold).select("path", "name", "complexity", "cognitive").orderBy(F.desc(metric), "path", "name").limit(limit)


def risk_hotspots(graph: CodeGraph, max_coverage: float = 50, min_commits: int = 1, metric: str = "complexity", threshold: int = 10, limit: int = 20) -> DataFrame:
    """Complex functions of badly covered files that change; without any churn in the graph that part is waived."""
    nodes = graph.nodes.where((F.col("coverage_pct") <= max_coverage)).select("path", "coverage_pct")
    if graph.commits is not None:
        facts = churn(graph).select("path", "commit_count_90d")
        any_churn = facts.agg(F.coalesce(F.max("commit_count_90d"), F.lit(0)).alias("top"))
        nodes = nodes.join(facts, "path", "left").crossJoin(F.broadcast(any_churn)).where((F.col("top") == 0) | (F.coalesce("commit_count_90d", F.lit(0)) >= min_commits)).drop("top")
    else:
        nodes = nodes.withColumn("commit_count_90d", F.lit(None).cast("bigint"))
    rows = graph.functions.where(F.col(metric) >= threshold).join(nodes, "path")
    return rows.select("path", "name", "complexity", "cognitive", "coverage_pct", "commit_count_90d").orderBy(F.desc(metric), "path", "name").limit(limit)


def uncovered(graph: CodeGraph, threshold: float = 80) -> DataFrame:
    """(path, coverage_pct) of files, neither tests nor config, whose known coverage is below the threshold."""
    return graph.nodes.where((F.col("coverage_pct") < threshold) & ~F.col("category").isin("test", "config")).select("path", "coverage_pct").orderBy("coverage_pct", "path")


def availability(graph: CodeGraph) -> DataFrame:
    """(has_coverage, has_churn)."""
    found = graph.nodes.agg((F.count("coverage_pct") > 0).alias("has_coverage"))
    commits = graph.commits.limit(1).agg((F.count("*") > 0).alias("has_churn")) if graph.commits is not None else graph.spark.range(1).select(F.lit(False).alias("has_churn"))
    return found.crossJoin(commits)


def slim(graph: CodeGraph) -> DataFrame:
    """(path, type, category, exports, tags, imports_files): names only; marker and import tags, internal targets."""
    none = F.array().cast("array<string>")
    names = graph.exports.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("exp_seq", "name"))).alias("e")).select("path", F.col("e.name").alias("exports"))
    tags = graph.tags.where("kind in ('comment-marker', 'import')").groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    files = graph.imports.where("not coalesce(is_external, false) and to_path <> ''").groupBy("path").agg(F.array_sort(F.collect_list("to_path")).alias("imports_files"))
    out = graph.nodes.select("path", "type", "category").join(names, "path", "left").join(tags, "path", "left").join(files, "path", "left")
    return out.select("path", "type", "category", *[F.coalesce(c, none).alias(c) for c in ("exports", "tags", "imports_files")])


def is_test_path(path: Column, stories: bool = False) -> Column:
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    out = F.lit(False)
    for p in (*TEST_NAMES, *((".stories.",) if stories else ())):
        out = out | base.contains(p)
    return out


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: ** any folders, * within one, ? one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in "\\.[]{}()+-^$|" else glob[i]), i + 1
    return f"^{out}$"


def owners(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, name): the first package (pkg_seq, name, relative_root) whose root a path of `files` lies under."""
    # equi-join on every ancestor folder of a path instead of comparing each path with each root
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))
    above = files.select("path", F.explode(folders).alias("root"))
    return above.join(packages.select("pkg_seq", "name", F.col("relative_root").alias("root")), "root").groupBy("path").agg(F.min_by("name", "pkg_seq").alias("name"))


def owner_packages(graph: CodeGraph, packages: DataFrame) -> DataFrame:
    """(path, name) of the files that lie in a package."""
    return owners(graph.nodes, packages)


def package_dependencies(graph: CodeGraph) -> DataFrame:
    """(package, depends_on) by workspace imports."""
    own = graph.nodes.select("path", "package")
    return graph.imports.where("is_workspace").join(own, "path").select("package", F.col("workspace_package").alias("depends_on")).distinct()


def affected_across_packages(graph: CodeGraph, file: str) -> DataFrame:
    """(path): files of the same package that depend on `file`, and every file elsewhere with an import from that package."""
    own = graph.nodes.where(F.col("path") == file).select("package")
    local = graph.nodes.join(own, "package", "left_semi").select("path")
    inner = graph.internal().join(local.withColumnRenamed("path", "src"), "src", "left_semi").join(local.withColumnRenamed("path", "dst"), "dst", "left_semi")
    inside = reach(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), graph.nodes.where(F.col("path") == file).select(F.col("path").alias("node"))).where("depth > 0").select(F.col("node").alias("path"))
    outside = graph.imports.where("is_workspace").join(own.withColumnRenamed("package", "workspace_package"), "workspace_package", "left_semi").join(local, "path", "left_anti").select("path")
    return inside.union(outside).distinct()


def workspace_summary(graph: CodeGraph) -> DataFrame:
    """(package, files, depends_on): every package with its number of files and the packages it imports; null for files of none."""
    deps = package_dependencies(graph).groupBy("package").agg(F.array_sort(F.collect_set("depends_on")).alias("depends_on"))
    return graph.nodes.groupBy("package").agg(F.count("*").alias("files")).join(deps.withColumnRenamed("package", "importer"), F.col("package").eqNullSafe(F.col("importer")), "left").select("package", "files", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))


def mermaid_lines(graph: CodeGraph) -> DataFrame:
    """(line) of a diagram: one for each pair of files, the first edge deciding its style."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    rows = graph.imports.where("to_path <> ''").groupBy("path", "to_path").agg(F.min_by("is_style", "edge_seq").alias("is_style"))
    arrow = F.when(F.col("is_style"), F.lit(" -- styles --> ")).otherwise(F.lit(" --> "))
    return rows.select(F.concat(F.lit("  "), q(F.col("path")), arrow, q(F.col("to_path"))).alias("line"))


def mermaid(graph: CodeGraph) -> str:
    """The diagram as one string; for graphs one would look at."""
    return "\n".join(["graph TD", *sorted(r.line for r in mermaid_lines(graph).collect())])


Exporter = Callable[[CodeGraph], str]
EXPORTERS: dict[str, Exporter] = {"mermaid": mermaid}


def export(graph: CodeGraph, to: str | Exporter = "mermaid") -> str:
    """The graph as text, by a known exporter or one of the caller's own."""
    return (EXPORTERS[to] if isinstance(to, str) else to)(graph)


def to_json_lines(graph: CodeGraph) -> DataFrame:
    """(json): every file with its imports, exports and tags nested again, sorted inside by their numbers or names."""
    nest = lambda df, by, name, *cols: df.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(by, *cols))).alias(name))
    out = graph.nodes.join(nest(graph.imports, "edge_seq", "imports", "to_path", "type", "symbols", "is_external"), "path", "left").join(nest(graph.exports, "exp_seq", "exports", "name", "signature"), "path", "left").join(nest(graph.tags, "name", "tags", "kind"), "path", "left")
    return out.select(F.to_json(F.struct(*out.columns)).alias("json"))


def document(graph: CodeGraph, slim_nodes: bool = False) -> DataFrame:
    """(part, json): the JSON output row by row; part is node, cycle or language, and there are no cycle rows without cycles."""
    nodes = slim(graph) if slim_nodes else None
    rows = nodes.select(F.to_json(F.struct(*nodes.columns)).alias("json")) if slim_nodes else to_json_lines(graph)
    languages = language_coverage(graph)
    part = lambda df, name: df.select(F.lit(name).alias("part"), "json")
    return part(rows, "node").union(part(cycles(graph).select(F.to_json("cycle").alias("json")), "cycle")).union(part(languages.select(F.to_json(F.struct(*languages.columns)).alias("json")), "language"))


def with_meta(graph: CodeGraph, found: DataFrame, column: str = "path") -> DataFrame:
    """`found` with category and exports of the file in `column`, both null for one outside the graph."""
    names = graph.exports.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("exp_seq", "name"))).alias("e"))
    meta = graph.nodes.join(names, "path", "left").select(F.col("path").alias(column), "category", F.coalesce(F.col("e.name"), F.array().cast("array<string>")).alias("exports"))
    return found.join(meta, column, "left")


def unused(graph: CodeGraph, files: DataFrame, exclude_tests: bool = False) -> DataFrame:
    """Files on disk (path) that aren't in the graph, on request without tests and stories."""
    found = unused_files(graph, files)
    return found.where(~is_test_path(F.col("path"), stories=True)) if exclude_tests else found


class NoCoverage(LookupError):
    """The graph has no coverage at all, so nothing can be said about what isn't covered."""


def find_uncovered(graph: CodeGraph, threshold: float | None = None, config: dict | None = None) -> DataFrame:
    """`uncovered` by the given threshold, the configured one ("coverageThreshold") or 80; raises without any coverage."""
    if graph.nodes.where("coverage_pct is not null").isEmpty():
        raise NoCoverage("no coverage data: load a report with enrich.with_coverage first")
    configured = (config or {}).get("coverageThreshold")
    return uncovered(graph, threshold if threshold is not None else configured if configured is not None else 80)

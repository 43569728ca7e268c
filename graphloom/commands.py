"""A session over project folders: the questions a tool or a command line asks, each answered by a frame.

A root is analyzed once and kept; file events mark it, and the next question builds it again, parsing only what
changed.  Everything a command needs beyond a graph (configuration, coverage, commits, caches) is held here.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.parse import parse_table
from graphloom.functions.tokens import cached_tokens
from graphloom.operators import apply_tags, duplicates, enrich, graph, reports
from graphloom.plans import dsl
from graphloom.plans.build import BuildOptions, build, build_workspace
from graphloom.plans.model import CodeGraph
from graphloom.plans.session import cut, delete, exists
from graphloom.sources import facts
from graphloom.sources.files import ScanOptions, scan
from graphloom.streaming.watch import ignored


@dataclass
class _Root:
    options: BuildOptions
    scan_options: ScanOptions
    entries: list[str] | None
    workspace: bool
    only: list[str] | None
    git_stats: bool
    coverage: str | None
    config: dict
    graph: CodeGraph | None = None
    files: DataFrame | None = None
    parsed: DataFrame | None = None
    tokens: dict | None = None
    impact: graph.Impact | None = None
    dirty: bool = True


class Session:
    """Questions by root; `git` may be another provider than the git command."""

    def __init__(self, spark: SparkSession, git: facts.GitProvider = facts._git):
        self.spark, self.git, self.roots = spark, git, {}

    # ---- building

    def analyze(self, root: str, entries: list[str] | None = None, options: BuildOptions | None = None, scan_options: ScanOptions = ScanOptions(), workspace: bool = False, only: list[str] | None = None, git_stats: bool = False, coverage: str | None = None) -> CodeGraph:
        """Builds a root.  What the options leave open comes from its tsconfig, go.mod, lock file and configuration."""
        config = facts.load_config(root)
        if options is None:
            base_url, ts_paths = facts.read_tsconfig(root)
            module, replaces = facts.go_module(root)
            options = BuildOptions(path_aliases=config.get("pathAliases", {}), base_url=base_url, ts_paths=ts_paths, go_module=module, go_replaces=replaces, lock=facts.lock_versions(self.spark, root))
        self.roots[root] = _Root(options, scan_options, entries or config.get("entryPoints"), workspace, only, git_stats, coverage or config.get("coverageReportPath"), config)
        return self.fresh(root)

    def mark(self, root: str, changed: list[str]) -> bool:
        """Marks a root whose files changed, unless all of them lie in ignored folders; True if it is marked."""
        if root in self.roots and any(not ignored(p) for p in changed):
            self.roots[root].dirty = True
        return root in self.roots and self.roots[root].dirty

    def fresh(self, root: str) -> CodeGraph:
        """The graph of a root, built again if it was marked; files with the same time and size aren't parsed again."""
        if root not in self.roots:
            raise LookupError(f"analyze {root} first")
        r = self.roots[root]
        if r.dirty:
            files = cut(scan(self.spark, root, r.scan_options))
            before = r.parsed
            if before is None:
                parsed = cut(parse_table(files, r.options.classify, r.options.parsers))
            else:
                same = before.join(files.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")
                parsed = cut(same.unionByName(parse_table(files.join(same.select("path"), "path", "left_anti"), r.options.classify, r.options.parsers)))
            if r.workspace:
                g = build_workspace(files, facts.detect_workspace(self.spark, root)[1], r.only, r.options, parsed)
            else:
                g = build(files, r.entries, r.options, parsed)
            if r.git_stats:
                g = g.with_tables(commits=cut(facts.commits_of(facts.log_entries(self.spark, facts.git_log(root, self.git)))))
            if r.coverage:
                g = enrich.with_coverage(g, facts.coverage(self.spark, r.coverage, root))
            r.graph, r.files, r.parsed, r.impact, r.dirty = enrich.enrich(g), files, parsed, None, False
        return r.graph

    def clear_cache(self, root: str | None = None, folder: str | None = None) -> list[str]:
        """Forgets a root, or all of them, and deletes what `save` wrote to the folder; the roots forgotten."""
        gone = [r for r in list(self.roots) if root in (None, r)]
        for r in gone:
            del self.roots[r]
        if folder:
            delete(self.spark, folder)
        return gone

    def save(self, root: str, folder: str) -> None:
        """Graph, parsed rows, tokens and blast radius of a root, to be taken up by `restore`."""
        g, r = self.fresh(root), self.roots[root]
        g.write(f"{folder}/graph")
        r.parsed.write.mode("overwrite").parquet(f"{folder}/parsed")
        for literal, tokens in (r.tokens or {}).items():
            tokens.write.mode("overwrite").parquet(f"{folder}/tokens-{int(literal)}")
        self._impact(root).save(f"{folder}/impact")

    def restore(self, root: str, folder: str) -> bool:
        """Takes up what `save` wrote for an analyzed root, whose next build parses only what has changed since; False if there is nothing."""
        if not exists(self.spark, f"{folder}/parsed/_SUCCESS"):
            return False
        r = self.roots[root]
        r.parsed, r.dirty = self.spark.read.parquet(f"{folder}/parsed"), True
        r.tokens = {x: self.spark.read.parquet(f"{folder}/tokens-{int(x)}") for x in (True, False) if exists(self.spark, f"{folder}/tokens-{int(x)}/_SUCCESS")}
        g, kept = self.fresh(root), graph.load_impact(self.spark, f"{folder}/impact")
        r.impact = kept if kept is not None and kept.is_current(g) else None
        return True

    def _impact(self, root: str) -> graph.Impact:
        g, r = self.fresh(root), self.roots[root]
        if r.impact is None:
            r.impact = graph.build_impact(g)
        return r.impact

    # ---- questions

    def get_dependencies(self, root: str, file: str, depth: int = 1, with_meta: bool = False) -> DataFrame:
        found = graph.dependencies(self.fresh(root), file, depth)
        return reports.with_meta(self.fresh(root), found) if with_meta else found

    def get_dependents(self, root: str, file: str, with_meta: bool = False) -> DataFrame:
        found = graph.dependents(self.fresh(root), file)
        return reports.with_meta(self.fresh(root), found) if with_meta else found

    def get_affected(self, root: str, file: str, tests_only: bool = False, changed_symbols: list[str] | None = None, cached: bool = False) -> DataFrame:
        """(path, ...) of what depends on the file; `cached` answers from the table of all files' blast radius."""
        if cached and not tests_only and changed_symbols is None:
            return self._impact(root).lookup(file)
        return graph.affected(self.fresh(root), file, tests_only, changed_symbols)

    def get_callers(self, root: str, file: str, depth: int = 1) -> DataFrame:
        return graph.callers(self.fresh(root), file, depth)

    def find_unused(self, root: str, exclude_tests: bool = False) -> DataFrame:
        return reports.unused(self.fresh(root), self.roots[root].files, exclude_tests)

    def list_tags(self, root: str) -> DataFrame:
        return reports.tag_histogram(self.fresh(root))

    def find_uncovered(self, root: str, threshold: float | None = None) -> DataFrame:
        return reports.find_uncovered(self.fresh(root), threshold, self.roots[root].config)

    def check_doc_drift(self, root: str) -> DataFrame:
        return enrich.doc_links(self.fresh(root)).where("stale")

    def find_complex_functions(self, root: str, **options) -> DataFrame:
        return reports.complex_functions(self.fresh(root), **options)

    def find_risk_hotspots(self, root: str, **options) -> DataFrame:
        return reports.risk_hotspots(self.fresh(root), **options)

    def find_duplicates(self, root: str, ignore_literals: bool = True, **options) -> DataFrame:
        """Duplicates among the files of the graph; their tokens are kept for the next time."""
        g, r = self.fresh(root), self.roots[root]
        files = r.files.join(g.nodes.select("path"), "path", "left_semi")
        r.tokens = r.tokens or {}
        r.tokens[ignore_literals] = cut(cached_tokens(files, r.tokens.get(ignore_literals), ignore_literals))
        return duplicates.find_duplicates(files, ignore_literals=ignore_literals, cache=r.tokens[ignore_literals], **options)

    def changed_files(self, root: str, base: str | None = None) -> list[str]:
        return [r.path for r in facts.changed_files(self.spark, root, base, self.git).collect()]

    def propose_tags(self, root: str, files: list[str] | None = None, base: str | None = None) -> DataFrame:
        """Tags for the given files, or for what git says has changed."""
        return graph.propose_tags(self.fresh(root), self.changed_files(root, base) if files is None else files)

    def affected_tests(self, root: str, files: list[str] | None = None, base: str | None = None) -> DataFrame:
        return graph.affected_tests(self.fresh(root), self.changed_files(root, base) if files is None else files)

    def detect_features(self, root: str, **options) -> DataFrame:
        return graph.feature_hubs(self.fresh(root), **options)

    def get_feature_graph(self, root: str, **options) -> tuple[DataFrame, DataFrame]:
        return graph.feature_domains(self.fresh(root), **options)

    def get_module_responsibility(self, root: str, **options) -> DataFrame:
        return graph.responsibility(self.fresh(root), **options)

    def query(self, root: str, text: str, slim: bool = True) -> DataFrame:
        nodes, imports = dsl.run(self.fresh(root), text)
        g = replace(self.fresh(root), nodes=nodes, imports=imports)
        return reports.slim(g) if slim else reports.to_json_lines(g)

    def check_cycles(self, root: str) -> DataFrame:
        return graph.cycles(self.fresh(root))

    def get_workspace_packages(self, root: str) -> DataFrame:
        return reports.workspace_summary(self.fresh(root))

    def get_workspace_affected(self, root: str, file: str) -> DataFrame:
        return reports.affected_across_packages(self.fresh(root), file)

    def get_type_graph(self, root: str, name: str | None = None):
        g = self.fresh(root)
        return (graph.type_nodes(g), graph.type_edges(g)) if name is None else graph.query_type(g, name)

    def get_call_graph(self, root: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        return graph.call_graph(self.fresh(root), name)

    def find_symbol(self, root: str, name: str) -> DataFrame:
        return graph.find_symbol(self.fresh(root), name)

    def get_api_surface(self, root: str, entries: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Public exports and file partition; without entry points those that the project publishes."""
        g = self.fresh(root)
        return graph.api_surface(g, entries or graph.detect_entry_points(g, root))

    def export(self, root: str, to: str | reports.Exporter = "mermaid") -> str:
        return reports.export(self.fresh(root), to)

    def apply_tags(self, root: str, write: bool = False, **options) -> DataFrame:
        """The new content of each test file, on request written where it was read."""
        found = apply_tags.preview(self.fresh(root), self.roots[root].files, **options)
        if write:
            found = cut(found)
            apply_tags.write(found, root)
            self.roots[root].dirty = True
        return found


def as_json(frame: DataFrame) -> str:
    """A small answer as one JSON array, for printing."""
    return "[" + ",".join(json.dumps(json.loads(r.j)) for r in frame.select(F.to_json(F.struct(*frame.columns)).alias("j")).collect()) + "]"

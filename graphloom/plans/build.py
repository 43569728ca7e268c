"""From files to a graph: parse, resolve, keep what entry points reach."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.classify import DEFAULT, STYLE_EXTENSIONS, ClassifyConfig
from graphloom.functions.parse import Parser, parse_table, parse_tasks
from graphloom.operators.enrich import package_of
from graphloom.operators.reports import is_test_path, owners
from graphloom.plans.model import CodeGraph
from graphloom.plans.session import cut
from graphloom.plans.traverse import reach

PROBES = {
    "script": ("", *".ts .tsx .js .jsx .mjs .cjs /index.ts /index.tsx /index.js /index.jsx".split()),
    "python": ("", ".py", "/__init__.py"),
    "lua": ("", ".lua", "/init.lua"),
    "style": ("", *STYLE_EXTENSIONS),
    "other": ("", *".coffee .ls .js /index.coffee /index.ls /index.js".split()),
    "markdown": ("", ".md"),
}


@dataclass(frozen=True)
class BuildOptions:
    classify: ClassifyConfig = DEFAULT
    path_aliases: dict[str, list[str]] = field(default_factory=dict)
    packages: DataFrame | None = None
    lock: DataFrame | None = None
    go_module: str | None = None
    #: Go module prefix -> folder that stands for it; wins over go_module, the longest prefix first.
    go_replaces: dict[str, str] = field(default_factory=dict)
    #: Folder from which bare specifiers of scripts are tried; tsconfig's baseUrl.
    base_url: str | None = None
    #: Aliases below path_aliases; tsconfig's paths, relative to the root.
    ts_paths: dict[str, list[str]] = field(default_factory=dict)
    parsers: dict[str, Parser] = field(default_factory=dict)
    #: (asked, files) -> rows of asked's columns and to_path that win over the rules here.
    resolver: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def normalize(path: Column) -> Column:
    """Without `.` and `..` segments; a path that climbs out of the root is null."""
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array(F.lit("..")))).otherwise(F.concat(acc, F.array(s)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.when(~F.array_contains(parts, ".."), F.concat_ws("/", parts))


def _bucket(kind: Column) -> Column:
    out = F.when(kind.isin("typescript", "javascript"), "script")
    for name in ("python", "lua", "go", "markdown"):
        out = out.when(kind == name, name)
    return out.when(kind.isin("css", "scss", "less", "stylus"), "style").otherwise("other")


def _candidates(edges: DataFrame, options: BuildOptions) -> DataFrame:
    """(…, candidate, priority): places where a specifier may lead, best first."""
    spec, folder = F.col("specifier"), F.col("folder")
    here = lambda x: F.concat_ws("/", folder, x)
    relative, kind = spec.startswith("."), F.col("bucket")
    dotted = F.translate(spec, ".", "/")
    bases = F.when(relative, F.array(here(spec)))
    bases = bases.when(kind == "python", F.array(dotted)).when(kind == "lua", F.array(dotted, F.concat(F.lit("lib/"), dotted))).when(kind == "markdown", F.array(spec, here(spec)))
    partial = F.regexp_replace(spec, r"([^/]+)$", "_$1")
    bases = bases.when(kind == "style", F.array(here(spec), here(partial)))
    aliases = F.array().cast("array<string>")
    for alias, targets in [*options.path_aliases.items(), *options.ts_paths.items()]:
        star = alias.rstrip("*")
        hit = spec.startswith(star) if alias.endswith("*") else spec == alias
        to = F.array(*[F.concat(F.lit(t.rstrip("*")), F.substr(spec, F.lit(len(star) + 1))) if t.endswith("*") else F.lit(t) for t in targets])
        aliases = F.concat(aliases, F.when(hit, to).otherwise(F.array().cast("array<string>")))
    bases = F.concat(aliases, F.coalesce(bases, F.array(spec)))
    if options.base_url is not None:
        under = F.concat_ws("/", F.lit(options.base_url.strip("./") or "."), spec)
        bases = F.concat(bases, F.when((kind == "script") & ~relative, F.array(under)).otherwise(F.array().cast("array<string>")))
    probe = F.lit(None).cast("array<string>")
    for name, tails in PROBES.items():
        probe = F.when(kind == name, F.array(*[F.lit(t) for t in tails])).otherwise(probe)
    probe = F.when(F.col("is_style"), F.array(*[F.lit(t) for t in PROBES["style"]])).otherwise(F.coalesce(probe, F.array(F.lit(""))))
    # a base that ends in a name is made plain once, before its endings
    named = lambda b: ~b.rlike(r"(^|/)\.{0,2}$")
    plain = F.transform(bases, lambda b: F.struct(b.alias("raw"), named(b).alias("named"), F.when(named(b), normalize(b)).alias("plain")))
    every = F.flatten(F.transform(plain, lambda b: F.transform(probe, lambda t: F.when(b["named"], F.concat(b["plain"], t)).otherwise(normalize(F.concat(b["raw"], t))))))
    return edges.select("*", F.posexplode(every).alias("priority", "candidate")).where("candidate is not null and candidate <> ''")


def resolve(edges: DataFrame, files: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """(folder, bucket, specifier, is_style, to_path, is_external, workspace_package): where each distinct specifier leads.

    `edges` needs folder, bucket, specifier and is_style.  A relative specifier that leads nowhere has no
    row, any other is external; a Go package leads to all its files that are no tests.
    """
    key = ["folder", "bucket", "specifier", "is_style"]
    # each row here becomes ten or more candidates, so all cores share them
    asked = edges.select(*key).repartition(parse_tasks(edges.sparkSession), *key).distinct()
    none = F.lit(None).cast("string")
    answer = lambda df, package=none: df.select(*key, "to_path", F.lit(False).alias("is_external"), package.alias("workspace_package"))
    without = lambda df, found: df.join(found.select(*key).distinct(), key, "left_anti")
    known = files.select(F.col("path").alias("candidate")).distinct()
    best = lambda df, *more: df.join(known, "candidate").groupBy(*key).agg(F.min_by("candidate", "priority").alias("to_path"), *[F.first(m).alias(m) for m in more])
    rest, local = asked, answer(asked.limit(0).withColumn("to_path", none))
    if options.resolver is not None:
        own = cut(options.resolver(asked, files).select(*key, "to_path"))
        local, rest = answer(own), without(asked, own)
    found = cut(best(_candidates(rest.where("bucket <> 'go' or specifier like '.%'"), options)))
    local = local.unionByName(answer(found))
    if options.go_module or options.go_replaces:
        folder = F.regexp_replace("path", r"/?[^/]*$", "")
        go_files = files.where("path like '%.go' and path not like '%\\_test.go'").select(F.col("path").alias("to_path"), folder.alias("go_folder"))
        inside = F.lit(None).cast("string")
        under = lambda module, to: F.when(F.col("specifier") == module, F.lit(to)).when(F.col("specifier").startswith(module + "/"), F.concat_ws("/", F.when(F.lit(to) != "", F.lit(to)), F.substr("specifier", F.lit(len(module) + 2))))
        if options.go_module:
            module = options.go_module.rstrip("/")
            # the module itself is no package of its own
            inside = F.when(F.col("specifier") != module, under(module, ""))
        for module, to in sorted(options.go_replaces.items(), key=lambda x: len(x[0])):
            inside = F.coalesce(under(module, to.removeprefix("./").strip("/")), inside)
        go = rest.where("bucket = 'go'").withColumn("go_folder", inside).join(go_files, "go_folder")
        local = local.unionByName(answer(go))
    rest = without(rest, local).where("specifier not like '.%'")
    if options.packages is not None:
        named = options.packages.select(F.col("name").alias("package_name"), "relative_root", F.get("entry_points", F.lit(0)).alias("entry"))
        hit = rest.withColumn("package_name", package_of(F.col("specifier"))).join(named, "package_name")
        exact = hit.where("specifier = package_name and entry is not null").select(*key, F.col("entry").alias("to_path"), "package_name")
        deep = F.substr("specifier", F.length("package_name") + 2)
        inner = F.when(F.col("specifier") == F.col("package_name"), F.array(F.lit("src/index"), F.lit("index"))).otherwise(F.array(deep, F.concat(F.lit("src/"), deep)))
        probes = F.array(*[F.lit(t) for t in PROBES["script"]])
        tried = hit.where("not (specifier = package_name and entry is not null)").select(*key, "package_name", F.posexplode(F.flatten(F.transform(inner, lambda x: F.transform(probes, lambda t: F.concat("relative_root", F.lit("/"), x, t))))).alias("priority", "candidate"))
        exact = cut(exact.unionByName(best(tried, "package_name").select(*exact.columns)))
        local, rest = local.unionByName(answer(exact, F.col("package_name"))), without(rest, exact)
    return local.unionByName(rest.select(*key, F.col("specifier").alias("to_path"), F.lit(True).alias("is_external"), none.alias("workspace_package")))


def assemble(parsed: DataFrame, options: BuildOptions = BuildOptions()) -> CodeGraph:
    """The graph of all parsed files."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    base = parsed.withColumn("folder", F.when(folder != "", folder)).withColumn("bucket", _bucket(F.col("type")))
    # the folder of a file at the root is null, which joins need as a value
    base = base.withColumn("folder", F.coalesce("folder", F.lit(".")))
    raw = base.select("path", "folder", "bucket", F.posexplode("imports").alias("edge_seq", "i")).select("path", "folder", "bucket", "edge_seq", "i.*")
    found = cut(resolve(raw.select("folder", "bucket", "specifier", "is_style").union(base.select("folder", "bucket", F.explode("calls").alias("c")).select("folder", "bucket", "c.specifier", F.lit(False).alias("is_style"))), parsed, options))
    key = ["folder", "bucket", "specifier", "is_style"]
    edges = raw.withColumn("forced", F.col("is_external")).drop("is_external").join(found, key)
    imports = edges.select("path", "edge_seq", "to_path", F.col("specifier").alias("raw_specifier"), "type", "is_style", "symbols", (F.coalesce("forced", F.lit(False)) | F.col("is_external")).alias("is_external"), F.col("workspace_package").isNotNull().alias("is_workspace"), "workspace_package")
    if options.lock is not None:
        lock = options.lock.select(F.col("name").alias("lock_name"), "version")
        imports = imports.withColumn("lock_name", package_of(F.col("raw_specifier"))).join(lock, "lock_name", "left").drop("lock_name").withColumn("version", F.when(F.col("is_external"), F.col("version")))
    else:
        imports = imports.withColumn("version", F.lit(None).cast("string"))
    calls = base.select("path", "folder", "bucket", F.posexplode("calls").alias("call_seq", "c")).select("path", "folder", "bucket", "call_seq", "c.*").withColumn("is_style", F.lit(False))
    calls = calls.join(found.where("not is_external"), key).select("path", "call_seq", "from_fn", "to_fn", F.col("to_path").alias("to_file"))
    child = lambda name, seq: parsed.select("path", F.posexplode(name).alias(seq, "x")).select("path", seq, "x.*")
    if options.packages is not None:
        owned = parsed.join(owners(parsed, options.packages).withColumnRenamed("name", "package"), "path", "left")
    else:
        owned = parsed.withColumn("package", F.lit(None).cast("string"))
    nodes = owned.select(F.xxhash64("path").alias("node_seq"), "path", "type", "category", "mtime", "size", "description", F.lit(None).cast("double").alias("coverage_pct"), "complexity", "cognitive", "package")
    return CodeGraph(nodes, imports.select("path", "edge_seq", "to_path", "raw_specifier", "type", "is_style", "symbols", "is_external", "version", "is_workspace", "workspace_package"), child("exports", "exp_seq"), child("tags", "tag_seq"), child("functions", "fn_seq"), calls)


def number_nodes(nodes: DataFrame) -> DataFrame:
    """node_seq by path order, without gathering the rows in one task: offsets of range partitions."""
    by_range = nodes.drop("node_seq").repartitionByRange("path").sortWithinPartitions("path").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    by_range = cut(by_range)
    sizes = by_range.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # one row a partition
    offsets = sizes.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return by_range.join(offsets, "part").withColumn("node_seq", F.col("offset") + F.col("at") - F.col("first")).drop("part", "at", "first", "offset")


def build(files: DataFrame, entries: list[str] | None = None, options: BuildOptions = BuildOptions(), before: DataFrame | None = None) -> CodeGraph:
    """Parses files (path, mtime, size, content) and keeps what the entry points, tests and documents reach.

    Tests are those below the folder that all entry points share, and those in a folder tests, test, __tests__,
    specs or spec beside it.  Without entry points all files stay.  `before` holds parsed rows of the last build: files whose mtime
    and size are the same aren't parsed again.
    """
    if before is not None:
        same = before.join(files.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")
        fresh = files.join(same.select("path"), "path", "left_anti")
        parsed = cut(same.unionByName(parse_table(fresh, options.classify, options.parsers)))
    else:
        parsed = cut(parse_table(files, options.classify, options.parsers))
    graph = assemble(parsed, options)
    graph = graph.with_tables(nodes=number_nodes(graph.nodes).select(graph.nodes.columns))
    if entries is None:
        return graph
    parents = {e.rsplit("/", 1)[0] if "/" in e else "" for e in entries}
    above = ""
    for parts in zip(*(p.split("/") for p in parents)):
        if len(set(parts)) > 1:
            break
        above = f"{above}{parts[0]}/" if parts[0] else above
    beside = above.rstrip("/").rsplit("/", 1)[0] + "/" if "/" in above.rstrip("/") else ""
    where = F.col("path").startswith(above)
    for name in ("tests", "test", "__tests__", "specs", "spec"):
        where = where | F.col("path").startswith(f"{beside}{name}/")
    tests = is_test_path(F.col("path")) & where
    seeds = graph.nodes.where(F.col("path").isin(entries) | tests | F.col("path").rlike(r"\.mdx?$")).select(F.col("path").alias("node"))
    inner = graph.imports.where("not is_external").select(F.col("path").alias("src"), F.col("to_path").alias("dst"))
    kept = cut(reach(inner, seeds).select(F.col("node").alias("path")))
    keep = lambda df: df.join(kept, "path", "left_semi")
    return CodeGraph(keep(graph.nodes), keep(graph.imports), keep(graph.exports), keep(graph.tags), keep(graph.functions), keep(graph.calls), graph.commits)


def build_workspace(files: DataFrame, packages: DataFrame, only: list[str] | None = None, options: BuildOptions = BuildOptions(), before: DataFrame | None = None) -> CodeGraph:
    """One graph over the packages (pkg_seq, name, relative_root, entry_points) with `package` of every file.

    Imports resolve against all packages.  `only` keeps the packages named by name or root: what their own entry
    points reach.  A package without entry points has no files; a file that several reach belongs to its owner.
    """
    options = replace(options, packages=packages)
    wanted = packages if only is None else packages.where(F.col("name").isin(only) | F.col("relative_root").isin(only))
    # a row a package: small, as a workspace lists them by hand
    entries = [e for r in wanted.select("entry_points").collect() for e in r.entry_points or []]
    return build(files, entries, options, before)

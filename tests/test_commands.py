import json
import os
import time

import pytest
from pyspark.sql import functions as F

from graphloom.commands import Session, as_json
from graphloom.operators import apply_tags, graph, reports
from graphloom.plans import dsl
from graphloom.plans.build import BuildOptions, assemble
from graphloom.plans.model import CodeGraph
from graphloom.functions.parse import parse_table
from graphloom.sources import facts

FILES = {
    "package.json": json.dumps({"name": "root", "workspaces": ["packages/*"], "exports": {".": {"import": "./dist/main.js"}, "./gone": "./nowhere.js"}}),
    "tsconfig.json": '{ // comment\n "compilerOptions": { "baseUrl": "./src", "paths": { "@lib/*": ["../lib/*", "libs/*"], "@own/*": ["wrong/*"], }, } }',
    "go.mod": "module example.com/m\n\ngo 1.22\nreplace (\n\texample.com/other v1.0.0 => ./third/other\n\tgithub.com/x => github.com/y v1.2.0\n)\n",
    "graphloom.config.json": json.dumps({"pathAliases": {"@own/*": ["src/own/*"]}, "coverageThreshold": 60}),
    "src/main.ts": 'import { a } from "@lib/a";\nimport { b } from "own/b";\nimport { c } from "@own/b";\nimport "./style.css";\nexport function run() { return a(b); }\n',
    "src/libs/a.ts": 'import { b } from "../own/b";\nexport function a(x) { return x; }\n',
    "src/own/b.ts": "export const b = 1;\n",
    "src/style.css": ".a { color: red }\n",
    "src/main.test.ts": 'import { run } from "./main";\ntest("x", () => run());\n',
    "src/unused.stories.ts": "export const z = 1;\n",
    "cmd/main.go": 'package main\nimport "example.com/m/pkg"\nimport "example.com/other/deep"\nimport "example.com/m"\nfunc Run() { pkg.Do() }\n',
    "pkg/a.go": "package pkg\nfunc Do() {}\n",
    "third/other/deep/d.go": "package deep\n",
    "root.go": "package m\n",
    "packages/app/package.json": json.dumps({"name": "@o/app", "main": "src/index.ts"}),
    "packages/app/src/index.ts": 'import { u } from "@o/lib";\nimport { v } from "@o/lib/src/deep";\nimport "@o/none";\n',
    "packages/lib/package.json": json.dumps({"name": "@o/lib"}),
    "packages/lib/src/index.ts": 'import { v } from "./deep";\nexport const u = v;\n',
    "packages/lib/src/deep.ts": "export const v = 1;\n",
}


@pytest.fixture()
def root(tmp_path):
    for name, text in FILES.items():
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(text)
    return str(tmp_path / "p")


def paths(df, column="path"):
    return sorted(r[column] for r in df.collect())


def test_session(spark, root, tmp_path):
    log = "\0h1\tzoe@x\t3000\n\nM\tsrc/main.ts\n"
    s = Session(spark, git=lambda r, *args: log if args[0] == "log" else "src/own/b.ts\n" if args[0] == "diff" else "")
    with pytest.raises(LookupError):
        s.get_dependents(root, "src/main.ts")
    g = s.analyze(root, git_stats=True)
    to = {(r.path, r.raw_specifier): r.to_path for r in g.imports.where("not is_external").collect()}
    assert to["src/main.ts", "@lib/a"] == "src/libs/a.ts" and to["src/main.ts", "own/b"] == "src/own/b.ts", "tsconfig's paths and base"
    assert to["src/main.ts", "@own/b"] == "src/own/b.ts", "the given aliases win"
    assert to["cmd/main.go", "example.com/m/pkg"] == "pkg/a.go" and to["cmd/main.go", "example.com/other/deep"] == "third/other/deep/d.go" and ("cmd/main.go", "example.com/m") not in to
    assert paths(s.get_dependencies(root, "src/main.ts")) == ["src/libs/a.ts", "src/own/b.ts", "src/style.css"]
    two = {r.path: (r.depth, r.category, r.exports) for r in s.get_dependencies(root, "src/main.test.ts", 2, with_meta=True).collect()}
    assert two["src/main.ts"][:1] == (1,) and two["src/own/b.ts"][0] == 2 and two["src/own/b.ts"][2] == ["b"]
    assert paths(s.get_affected(root, "src/own/b.ts")) == paths(s.get_affected(root, "src/own/b.ts", cached=True)) == ["src/libs/a.ts", "src/main.test.ts", "src/main.ts"]
    assert paths(s.affected_tests(root)) == ["src/main.test.ts"] and paths(s.find_unused(root)) == []
    assert graph.detect_entry_points(g, root) == ["src/main.ts"]
    assert {r.name: r.defined_in for r in s.get_api_surface(root)[0].collect()} == {"run": "src/main.ts"}
    with pytest.raises(reports.NoCoverage):
        s.find_uncovered(root)
    assert json.loads(as_json(s.list_tags(root).limit(1)))[0]["n"] > 0
    assert s.find_duplicates(root).count() == 0 and s.query(root, "category:test").count() == 1
    # a change is seen by the next question and only that file is parsed again
    assert not s.mark(root, ["node_modules/x.js"]) and s.mark(root, ["src/own/b.ts"])
    parsed = s.roots[root].parsed
    (time.sleep(0.01), open(f"{root}/src/own/b.ts", "w").write('import "../style.css";\nexport const b = 22;\n'))
    s.roots[root].parsed = parsed.withColumn("description", F.lit("kept"))
    assert paths(s.get_dependents(root, "src/style.css")) == ["src/main.ts", "src/own/b.ts"]
    assert {r.path for r in s.fresh(root).nodes.where("description <> 'kept' or description is null").collect()} == {"src/own/b.ts"}
    folder = str(tmp_path / "cache")
    s.save(root, folder)
    other = Session(spark)
    other.analyze(root)
    assert other.restore(root, folder) and other.roots[root].impact is not None and not other.restore(root, str(tmp_path / "none"))
    assert CodeGraph.read(spark, f"{folder}/graph").commits.count() == 1
    assert s.clear_cache(folder=folder) == [root] and not os.path.exists(folder)
    assert Session(spark).clear_cache() == []


def test_workspace_over_built_packages(spark, root):
    s = Session(spark)
    g = s.analyze(root, workspace=True)
    assert {r.package: (r.files, r.depends_on) for r in s.get_workspace_packages(root).where("package is not null").collect()} == {"@o/app": (1, ["@o/lib"]), "@o/lib": (2, [])}
    assert {(r.raw_specifier, r.to_path, r.is_workspace) for r in g.imports.where("path = 'packages/app/src/index.ts'").collect()} == {("@o/lib", "packages/lib/src/index.ts", True), ("@o/lib/src/deep", "packages/lib/src/deep.ts", True), ("@o/none", "@o/none", False)}
    assert paths(s.get_workspace_affected(root, "packages/lib/src/deep.ts")) == ["packages/app/src/index.ts", "packages/lib/src/index.ts"]
    assert {(r.package, r.depends_on) for r in reports.package_dependencies(g).collect()} == {("@o/app", "@o/lib")}
    only = s.analyze(root, workspace=True, only=["packages/lib"])
    assert {r.package for r in only.nodes.where("package is not null").collect()} == {"@o/lib"}


def test_extensions(spark):
    node = lambda i, p, c="logic": {"node_seq": i, "path": p, "type": "typescript", "category": c, "mtime": 0.0, "size": 1}
    edge = lambda a, b, k=0: {"path": a, "edge_seq": k, "to_path": b, "raw_specifier": b, "type": "static", "is_style": False, "symbols": None, "is_external": False}
    g = CodeGraph.from_rows(spark, nodes=[node(0, "h1"), node(1, "h2"), node(2, "x"), node(3, "check_x")], imports=[edge("h1", "x"), edge("h2", "x"), edge("h2", "h1", 1), edge("check_x", "x"), edge("x", "check_x")], exports=[], tags=[{"path": "check_x", "tag_seq": 0, "name": "slow", "kind": "import"}])
    detect = lambda g: g.nodes.where("path like 'h%'")
    assert [r.path for r in graph.feature_hubs(g, detect=detect).collect()] == ["h2", "h1"]
    hub = lambda **o: {r.path: r.hub for r in graph.feature_assignment(g, detect=detect, **o).collect()}["x"]
    assert hub() == "h1" and hub(order=(F.desc("out_degree"),) if False else (-F.col("out_degree"),)) == "h2"
    identify = lambda nodes: F.col("path").startswith("check_")
    assert paths(graph.affected(g, "x", tests_only=True, identify=identify)) == ["check_x"] and paths(graph.affected_tests(g, ["x"], identify=identify)) == ["check_x"]
    assert reports.export(g, lambda g: str(g.nodes.count())) == "4" and reports.export(g).startswith("graph TD")
    cycles = graph.cycles(g)
    assert [r.cycle for r in cycles.collect()] == [["x", "check_x", "x"]] == graph.first_cycles(g)
    assert dsl.trim_cycles(cycles, dsl.run(g, "path:x")[0]).count() == 1 and dsl.trim_cycles(cycles, dsl.run(g, "path:check")[0]).count() == 0
    parts = {r.part: r.n for r in reports.document(g).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"node": 4, "cycle": 1, "language": 1}
    tested = CodeGraph.from_rows(spark, nodes=[node(0, "t.test.ts", "test")], tags=[{"path": "t.test.ts", "tag_seq": 0, "name": "slow", "kind": "import"}])
    files = spark.createDataFrame([("t.test.ts", "body")], "path STRING, content STRING")
    got = apply_tags.preview(tested, files, {"*.test.ts": "banner"}, {"banner": lambda source, tags: f"// {' '.join(tags)}\n{source}"}).first()
    assert (got.strategy, got.content) == ("banner", "// slow\nbody")
    rows = spark.createDataFrame([("a.ts", 1.0, 1, 'import "virtual:x";'), ("real.ts", 1.0, 1, "")], "path STRING, mtime DOUBLE, size BIGINT, content STRING")
    own = lambda asked, files: asked.where("specifier like 'virtual:%'").withColumn("to_path", F.lit("real.ts"))
    assert [(r.to_path, r.is_external) for r in assemble(parse_table(rows), BuildOptions(resolver=own)).imports.collect()] == [("real.ts", False)]


def test_cycles_in_the_order_of_one_walk(spark):
    node = lambda i, p: {"node_seq": i, "path": p, "type": "typescript", "category": "logic", "mtime": 0.0, "size": 1}
    edge = lambda a, b, k: {"path": a, "edge_seq": k, "to_path": b, "raw_specifier": b, "type": "static", "is_style": False, "symbols": None, "is_external": False}
    g = CodeGraph.from_rows(spark, nodes=[node(i, p) for i, p in enumerate("zabcd")], imports=[edge("z", "c", 0), edge("a", "b", 0), edge("b", "c", 0), edge("c", "a", 0), edge("d", "d", 0), edge("b", "d", 1)])
    assert graph.first_cycles(g) == [["c", "a", "b", "c"], ["d", "d"]], "the walk from z enters the cycle at c"


def test_manifests():
    assert facts.parse_go_mod("module a/b\nreplace x/y => ../local\nreplace z v1 => w v2\n") == ("a/b", {"x/y": "../local"})
    assert facts.parse_go_mod("") == (None, {}) and facts.read_tsconfig("/nowhere") == (None, {}) and facts.go_module("/nowhere") == (None, {})

import json
import subprocess

from pyspark.sql import functions as F

from graphloom.functions.tokens import block_table, token_table
from graphloom.operators import duplicates, enrich, graph
from graphloom.plans.build import BuildOptions, assemble, build
from graphloom.plans.model import CodeGraph
from graphloom.sources import facts
from graphloom.sources.files import ScanOptions, changed, scan
from graphloom.functions.parse import parse_table
from graphloom.streaming import watch

FILES = {
    "src/main.ts": 'import { add } from "./util";\nimport "./style.css";\nimport React from "react";\nimport { x } from "@app/deep";\nimport "./missing";\nexport function go() { return add(1); }\n',
    "src/util/index.ts": "export function add(a) { return a; }\n",
    "src/style.css": '@import "base.css";\n.a { color: red }\n',
    "src/base.css": ".b { margin: 0 }\n",
    "lib/deep.ts": "export const x = 1;\n",
    "src/main.test.ts": 'import { go } from "./main";\ntest("main runs", () => go());\n',
    "docs/readme.md": "See [main](../src/main.ts) and `src/alone.ts`.\n",
    "src/alone.ts": "export const y = 2;\n",
    "py/app.py": "from .models import User\nimport py.models\nimport os\n",
    "py/models.py": "class User: pass\n",
    "cmd/main.go": 'package main\nimport "example.com/m/pkg"\nfunc Run() { pkg.Do() }\n',
    "pkg/a.go": "package pkg\nfunc Do() {}\n",
    "pkg/b.go": "package pkg\n",
    "pkg/a_test.go": "package pkg\n",
    "node_modules/react/index.js": "module.exports = {}\n",
    "src/notes.txt": "no source",
    "src/broken.py": "def (",
}


def tree(root):
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_scan_build_and_incremental(spark, tmp_path):
    root = tree(tmp_path / "proj")
    files = scan(spark, root)
    assert sorted(r.path for r in files.collect()) == sorted(n for n in FILES if not n.startswith("node_modules") and not n.endswith(".txt"))
    assert {r.path for r in scan(spark, root, ScanOptions(extensions=(".TXT",))).collect()} == {"src/notes.txt"}
    options = BuildOptions(path_aliases={"@app/*": ["lib/*"]}, go_module="example.com/m", lock=spark.createDataFrame([("react", "19.0.0")], "name STRING, version STRING"))
    g = build(files, options=options)
    found = {(r.path, r.raw_specifier, r.to_path, r.is_external, r.version) for r in g.imports.collect()}
    assert {x for x in found if x[0] == "src/main.ts"} == {("src/main.ts", "./util", "src/util/index.ts", False, None), ("src/main.ts", "./style.css", "src/style.css", False, None), ("src/main.ts", "react", "react", True, "19.0.0"), ("src/main.ts", "@app/deep", "lib/deep.ts", False, None)}
    to = {(a, c) for a, _, c, e, _ in found if not e}
    assert {("src/style.css", "src/base.css"), ("src/main.test.ts", "src/main.ts"), ("docs/readme.md", "src/main.ts"), ("docs/readme.md", "src/alone.ts"), ("py/app.py", "py/models.py"), ("cmd/main.go", "pkg/a.go"), ("cmd/main.go", "pkg/b.go")} <= to
    assert ("cmd/main.go", "pkg/a_test.go") not in to
    assert {(r.path, r.to_fn, r.to_file) for r in g.calls.collect()} >= {("src/main.ts", "add", "src/util/index.ts"), ("cmd/main.go", "Do", "pkg/a.go")}
    assert [r.node_seq for r in g.nodes.orderBy("path").collect()] == list(range(g.nodes.count()))
    assert g.nodes.where("path = 'src/broken.py'").first().category == "other"
    small = build(files, ["src/main.ts"], options)
    assert {r.path for r in small.nodes.collect()} == {"src/main.ts", "src/util/index.ts", "src/style.css", "src/base.css", "lib/deep.ts", "src/main.test.ts", "docs/readme.md", "src/alone.ts"}
    assert {r.path for r in graph.unused_files(small, files).collect()} >= {"py/app.py", "cmd/main.go"}
    before = parse_table(files)
    assert changed(files, before).count() == 0
    again = build(files, options=options, before=before)
    assert {tuple(r)[:3] for r in again.imports.select("path", "edge_seq", "to_path").collect()} == {tuple(r)[:3] for r in g.imports.select("path", "edge_seq", "to_path").collect()}
    g.write(str(tmp_path / "graph"))
    assert CodeGraph.read(spark, str(tmp_path / "graph")).imports.count() == g.imports.count()
    assert assemble(parse_table(files.limit(0))).nodes.count() == 0


def test_tokens_and_style_rules(spark):
    code = "const a = 1;\nlet b = 2;\nfor (;;) { run(a, b); }\n"
    files = spark.createDataFrame([("a.ts", code), ("b.ts", code), ("c.css", ".h {\n color: red;\n margin: 0;\n}\n.f {\n color: red;\n margin: 0;\n}"), ("yarn.lock", "x"), ("d.md", "# x")], "path STRING, content STRING")
    found = duplicates.token_duplicates(token_table(files), 10, 3, 1.0).collect()
    assert [sorted(o.file for o in r.occurrences) for r in found] == [["a.ts", "b.ts"]]
    rules = duplicates.style_duplicates(block_table(files), 3).collect()
    assert [(r.file_a, r.start_a, r.start_b) for r in rules] == [("c.css", 1, 5)]


def test_git_coverage_and_locks(spark, tmp_path):
    log = "\0h3\tzoe@x\t3000\n\nM\tsrc/a.ts\nR100\tsrc/old.ts\tsrc/new.ts\n\0h2\tamy@x\t2000\n\nA\tsrc/a.ts\nA\tsrc/old.ts\n"
    commits = facts.commits_of(facts.log_entries(spark, log))
    assert sorted((r.path, r.author, r.log_seq) for r in commits.collect()) == [("src/a.ts", "amy@x", 1), ("src/a.ts", "zoe@x", 2), ("src/new.ts", "zoe@x", 2), ("src/old.ts", "amy@x", 1)]
    g = CodeGraph.from_rows(spark).with_tables(commits=commits)
    assert {r.path: (r.commit_count_90d, r.last_author) for r in enrich.churn(g).collect()} == {"src/a.ts": (2, "zoe@x"), "src/new.ts": (1, "zoe@x"), "src/old.ts": (1, "amy@x")}
    assert {r.path: (r.commit_count_90d, r.last_author) for r in enrich.churn(g, F.timestamp_seconds(F.lit(10**8))).collect()}["src/a.ts"] == (0, None)
    report = tmp_path / "c.json"
    report.write_text(json.dumps({"total": {"lines": {"pct": 1}}, "/p/src/a.ts": {"lines": {"pct": 81.5}}, "/p/b.ts": {"lines": {"pct": "Unknown"}}}))
    assert [tuple(r) for r in facts.coverage(spark, str(report), "/p").collect()] == [("src/a.ts", 81.5)] and facts.coverage(spark, "/none", "/p").count() == 0
    assert facts.parse_package_lock('{"packages": {"": {}, "node_modules/@s/t": {"version": "2.5.0"}, "node_modules/left": {"version": "7.0.1"}, "node_modules/a/node_modules/b": {"version": "1.0.0"}}}') == {"@s/t": "2.5.0", "left": "7.0.1"}
    assert facts.parse_package_lock('{"dependencies": {"a": {"version": "1.0.0"}}}') == {"a": "1.0.0"}
    assert facts.parse_yarn_lock('# v1\n\n"@b/c@^1.0.0":\n  version "1.2.3"\n\na@^1, a@^2:\n  version "2.0.0"\n') == {"@b/c": "1.2.3", "a": "2.0.0"}
    assert facts.parse_yarn_lock('__metadata:\n  version: 6\n\n"a@npm:^1":\n  version: 1.5.0\n') == {"a": "1.5.0"}
    assert facts.parse_pnpm_lock("packages:\n  /@a/b@1.0.0:\n    x: 1\n  /c@2.0.0(d@1):\n    y: 1\n") == {"@a/b": "1.0.0", "c": "2.0.0"}


def test_workspace_and_git_changes(spark, tmp_path):
    root = tmp_path / "mono"
    for name, manifest in (("", {"workspaces": ["packages/*", "!packages/skip"]}), ("packages/app", {"name": "@o/app", "main": "dist/index.js"}), ("packages/lib", {"name": "@o/lib"}), ("packages/skip", {"name": "skip"})):
        (root / name / "src").mkdir(parents=True, exist_ok=True)
        (root / name / "package.json").write_text(json.dumps(manifest))
    (root / "packages/app/src/index.ts").write_text("")
    kind, packages = facts.detect_workspace(spark, str(root))
    assert kind == "npm" and [(r.name, r.relative_root, r.entry_points) for r in packages.orderBy("pkg_seq").collect()] == [("@o/app", "packages/app", ["packages/app/src/index.ts"]), ("@o/lib", "packages/lib", [])]
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    assert {r.path for r in facts.changed_files(spark, str(root)).collect()} >= {"package.json"}
    assert facts.changed_files(spark, str(tmp_path / "nowhere")).count() == 0


def test_watch(spark, tmp_path):
    drop = tmp_path / "events"
    drop.mkdir()
    rows = [{"path": "src/a.ts", "mtime": 1.0, "size": 1}, {"path": "src/a.ts", "mtime": 2.0, "size": 5}, {"path": "node_modules/x.js", "mtime": 1.0, "size": 1}]
    (drop / "1.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    watch.watch(watch.file_events(spark, str(drop)), lambda df, n: seen.append([tuple(r) for r in df.collect()]), str(tmp_path / "ck"), None).awaitTermination(60)
    assert seen == [[("src/a.ts", 2.0, 5)]] and watch.ignored("a/dist/b.js") and not watch.ignored("src/distance.ts")
    nodes = spark.createDataFrame([("src/a.ts", 1.0, 1), ("b", 1.0, 1)], "path STRING, mtime DOUBLE, size INT")
    new = spark.createDataFrame([("src/a.ts", 2.0, 5)], nodes.schema)
    assert sorted(map(tuple, watch.upsert(nodes, new, new).collect())) == [("b", 1.0, 1), ("src/a.ts", 2.0, 5)]

import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions.tokens import cached_tokens
from graphloom.operators import apply_tags, duplicates, enrich, graph, reports
from graphloom.plans import dsl
from graphloom.plans.model import CodeGraph
from graphloom.plans.traverse import all_pairs, connected, reach, reference_cycles, strongly_connected
from graphloom.plans.virtual import load


def node(i, path, category="logic", **more):
    return {"node_seq": i, "path": path, "type": more.pop("type", "typescript"), "category": category, "mtime": 0.0, "size": more.pop("size", 0), **more}


def edge(a, b, symbols=None, k=0, **more):
    return {"path": a, "edge_seq": k, "to_path": b, "raw_specifier": b, "type": more.pop("type", "static"), "is_style": False, "symbols": symbols, "is_external": more.pop("external", False), **more}


@pytest.fixture(scope="module")
def triangle(spark):
    return CodeGraph.from_rows(
        spark,
        nodes=[node(0, "lib/one.ts"), node(1, "lib/two.ts"), node(2, "lib/one.test.ts", "test")],
        imports=[edge("lib/two.ts", "lib/one.ts", ["foo"]), edge("lib/one.test.ts", "lib/one.ts")],
        exports=[{"path": "lib/one.ts", "exp_seq": 0, "name": "foo"}],
        tags=[{"path": "lib/one.ts", "tag_seq": 0, "name": "auth", "kind": "comment-marker"}, {"path": "lib/one.test.ts", "tag_seq": 0, "name": "a", "kind": "comment-marker"}],
        functions=[{"path": "lib/one.ts", "fn_seq": 0, "name": "foo", "line": 1, "complexity": 12, "cognitive": 15}, {"path": "lib/one.ts", "fn_seq": 1, "name": "bar", "line": 10, "complexity": 2, "cognitive": 1}],
        calls=[{"path": "lib/two.ts", "call_seq": 0, "from_fn": "run", "to_fn": "foo", "to_file": "lib/one.ts"}],
    )


def paths(df, column="path"):
    return sorted(r[column] for r in df.collect())


def test_one_hop(triangle):
    g = triangle
    assert [tuple(r) for r in graph.dependencies(g, "lib/two.ts").collect()] == [("lib/one.ts", 1, ["foo"])]
    assert paths(graph.dependencies(g, "lib/two.ts", 10)) == ["lib/one.ts"]
    assert paths(graph.dependents(g, "lib/one.ts")) == "lib/one.test.ts lib/two.ts".split() and paths(graph.dependents(g, "react")) == []
    assert paths(graph.affected(g, "lib/one.ts", tests_only=True)) == ["lib/one.test.ts"]
    assert paths(graph.affected(g, "lib/one.ts", changed_symbols=["other"])) == ["lib/one.test.ts"], "a whole-module import is always affected"
    assert paths(graph.affected(g, "lib/one.ts", changed_symbols=["foo"])) == "lib/one.test.ts lib/two.ts".split()
    assert [(r.path, [tuple(e) for e in r.edges]) for r in graph.callers(g, "lib/one.ts").collect()] == [("lib/two.ts", [("run", "foo")])]
    assert [r.name for r in reports.complex_functions(g).collect()] == ["foo"]
    assert {(r.user, r.via) for r in graph.find_symbol(g, "foo").collect()} == {("lib/two.ts", "run")}
    assert 'graph TD\n  "lib/one.test.ts" --> "lib/one.ts"' in reports.mermaid(g)
    assert {(r.path, r.name, r.kind) for r in enrich.test_tags(g).collect()} == {("lib/one.test.ts", "one", "import"), ("lib/one.test.ts", "auth", "comment-marker")}
    e = enrich.enrich(g)
    assert {r.path: r.tested_by for r in e.nodes.collect()}["lib/one.ts"] == ["lib/one.test.ts"]
    tagged = apply_tags.preview(e, g.spark.createDataFrame([("lib/one.test.ts", "import { it } from 'vitest'\nit('x', () => {})\n")], "path STRING, content STRING"))
    assert [(r.strategy, r.status, r.tags) for r in tagged.collect()] == [("vitest", "updated", ["one"])]


def test_trim_keeps_edges_without_a_target(spark):
    g = CodeGraph.from_rows(spark, nodes=[node(0, "a"), node(1, "b"), node(2, "gone", "other")], imports=[edge("a", "b", k=0), edge("a", "gone", k=1), edge("a", "", k=2, external=True)])
    nodes, imports = dsl.run(g, "category:logic")
    assert paths(nodes) == ["a", "b"] and sorted(r.to_path for r in imports.collect()) == ["", "b"]
    assert paths(dsl.run(g, "external:true")[0]) == ["a"] and paths(dsl.run(g, "external:false")[0]) == ["b", "gone"]
    assert [r.path for r in dsl.run(g, "sort:imports,limit:1")[0].collect()] == ["a"] and dsl.run(g, "limit:x")[0].count() == 0
    with pytest.raises(ValueError):
        dsl.run(g, "limit:-1")


def test_parse_dsl():
    q = dsl.parse("Category: ui ,tag:a+b,tags:!c,tag:d, nonsense, minSize:10abc,maxSize:x,any(type:go|minImports:2|bad),unknown:1,limit:5,sortDir:ASC,path:")
    assert (q.category, q.all_tags, q.tags, q.minsize, q.limit, q.sortdir, q.path) == ("ui", ["a", "b"], ["!c", "d"], 10, 5, "asc", None)
    assert q.maxsize != q.maxsize and [(a.type, a.minimports) for a in q.any_of] == [("go", None), (None, 2.0)]


def closure(edges, start):
    seen, todo = {start: 0}, [start]
    while todo:
        nxt = []
        for a in todo:
            for x, y in edges:
                if x == a and y not in seen:
                    seen[y] = seen[a] + 1
                    nxt.append(y)
        todo = nxt
    return seen


def test_reach_matches_breadth_first_search(spark):
    rng = random.Random(3)
    for n, m in ((12, 14), (25, 60), (30, 29)):
        edges = [(rng.randint(0, n), rng.randint(0, n)) for _ in range(m)] if m != 29 else [(i, i + 1) for i in range(29)]
        df = spark.createDataFrame(edges, "src INT, dst INT")
        seeds = spark.createDataFrame([(0,)], "node INT")
        want = closure(edges, 0)
        assert dict(map(tuple, reach(df, seeds).collect())) == want
        for depth in (1, 2, 4):
            assert dict(map(tuple, reach(df, seeds, depth).collect())) == {k: v for k, v in want.items() if v <= depth}
        stop = spark.createDataFrame([(3,), (0,)], "node INT")
        cut = closure([e for e in edges if e[0] not in (3,)], 0)
        assert {r.node for r in reach(df, seeds, stop=stop).collect()} == set(cut)
    pairs = all_pairs(df, spark.createDataFrame([(i,) for i in range(30)], "node INT"))
    assert pairs.count() == 29 * 30 // 2


def test_components_and_cycles(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(38)] + [(50, 51), (51, 50), (60, 60), (61, 62)]
    up = {a: set(closure(edges, a)) for a in {x for e in edges for x in e}}
    want = {a: min(b for b in up[a] if a in up[b]) for a in up if any(a in up[y] for x, y in edges if x == a)}
    assert dict(map(tuple, strongly_connected(spark.createDataFrame(edges, "src INT, dst INT")).collect())) == want
    assert reference_cycles([(0, 0, 1), (1, 0, 0), (1, 1, 2), (2, 0, 2), (3, 0, 1)]) == [[0, 1, 0], [2, 2]]


def test_hubs_are_inclusive(spark):
    make = lambda n: CodeGraph.from_rows(spark, nodes=[node(0, "src/feature/index.ts"), *[node(i + 1, f"src/{i}.ts") for i in range(n)]], imports=[edge("src/feature/index.ts", f"src/{i}.ts", k=i) for i in range(n)])
    assert graph.feature_hubs(make(4)).count() == 0 and graph.feature_hubs(make(5)).first().label == "feature"
    domains, rest = graph.feature_domains(make(5))
    assert len(domains.first().files) == 5 and rest.count() == 0


def test_roles(spark):
    rows = [("src/components/x.ts", "logic", "component"), ("src/cli.ts", "logic", "cli"), ("src/a/store.ts", "logic", "store"), ("src/builder.ts", "logic", "builder"), ("x", "test", "test"), ("y", "logic", "other"), ("src/storefront.ts", "logic", "other")]
    df = spark.createDataFrame(rows, "path STRING, category STRING, want STRING").select(graph.role(F.col("path"), F.col("category")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect())


def maximal(streams, width):
    """All left- and right-maximal repeats by brute force: (tokens, places)."""
    places = {}
    for f, s in streams.items():
        for i in range(len(s)):
            for j in range(i + width, len(s) + 1):
                places.setdefault(tuple(s[i:j]), []).append((f, i))
    out = set()
    for t, own in places.items():
        lefts = {streams[f][i - 1] if i else None for f, i in own}
        rights = {streams[f][i + len(t)] if i + len(t) < len(streams[f]) else None for f, i in own}
        if len(own) > 1 and (len(lefts) > 1 or None in lefts) and (len(rights) > 1 or None in rights):
            out.add((len(t), tuple(sorted(own))))
    return out


def test_repeats_match_brute_force(spark):
    rng = random.Random(1)
    for width in (2, 3, 4):
        trials = {f"t{k}": {f"f{i}": [rng.choice("abcd" if k % 3 else "ab") for _ in range(rng.randint(5, 19))] for i in range(rng.randint(2, 4))} for k in range(200)}
        for k in range(0, 200, 7):  # copies, whole and with an end of their own
            trials[f"t{k}"] |= {"g0": trials[f"t{k}"]["f0"], "g1": trials[f"t{k}"]["f0"][:-2], "g2": ["d", *trials[f"t{k}"]["f0"]]}
        rows = [(t, f, i, x, 1) for t, streams in trials.items() for f, s in streams.items() for i, x in enumerate(s)]
        tokens = spark.createDataFrame(rows, "family STRING, file STRING, pos INT, text STRING, line INT")
        got = {}
        for r in duplicates.maximal_repeats(tokens, width).collect():
            got.setdefault(r.family, set()).add((r.tokens, tuple((p.file, p.pos) for p in r.places)))
        assert got == {t: want for t, streams in trials.items() if (want := maximal(streams, width))}


def test_find_duplicates_and_token_cache(spark):
    code = "\n".join(f"let v{i} = call(a{i}, {i});" for i in range(8))
    rule = ".x {\n" + "\n".join(f" p{i}: {i}px;" for i in range(6)) + "\n}\n"
    rows = [("a.ts", code), ("lib/b.ts", code + "\nend()"), ("vendor/c.ts", code), ("package-lock.json", code), ("s.css", rule + ".y { z: 1 }"), ("t.scss", rule), ("u.styl", code)]
    files = spark.createDataFrame([(p, 1.0, len(t), t) for p, t in rows], "path STRING, mtime DOUBLE, size INT, content STRING")
    found = [(r.family, r.lines, sorted(o.file for o in r.occurrences)) for r in duplicates.find_duplicates(files, ignore_dirs=("vendor",)).collect()]
    assert found[0] == ("code", 8, ["a.ts", "lib/b.ts"]) and ("style", 7, ["s.css", "t.scss"]) in found
    assert not {f for *_, files in found for f in files} & {"package-lock.json", "u.styl", "vendor/c.ts"} and [n for _, n, _ in found] == sorted((n for _, n, _ in found), reverse=True)
    first = cached_tokens(files, None)
    marked = first.withColumn("text", F.when(F.col("file") == "a.ts", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    changed = files.where("path <> 'u.styl'").withColumn("mtime", F.when(F.col("path") == "lib/b.ts", 2.0).otherwise(F.col("mtime")))
    again = cached_tokens(changed, marked)
    assert {r.file for r in again.select("file").distinct().collect()} == {"a.ts", "lib/b.ts", "vendor/c.ts"}
    assert again.where("file = 'a.ts' and text like '%!'").count() == first.where("file = 'a.ts'").count() and again.where("file = 'lib/b.ts' and mtime = 2.0").count() > 0
    assert cached_tokens(files, marked, ignore_literals=False).where("text like '%!'").count() == 0
    assert duplicates.find_duplicates(files, cache=first, ignore_dirs=("vendor",)).count() == len(found)


def test_token_duplicates(spark):
    body = list("abcdefghijklmno")
    rows = [("code", f, i, t, i // 3 + 1) for f in ("x.ts", "y.ts") for i, t in enumerate(body)] + [("code", "z.ts", i, t, 1) for i, t in enumerate("zzz")]
    tokens = spark.createDataFrame(rows, "family STRING, file STRING, pos INT, text STRING, line INT")
    found = duplicates.token_duplicates(tokens, 5, 3).collect()
    assert [(r.lines, r.tokens, [(o.file, o.start_line, o.end_line) for o in r.occurrences]) for r in found] == [(5, 15, [("x.ts", 1, 5), ("y.ts", 1, 5)])]
    assert duplicates.token_duplicates(tokens.limit(0), 5, 3).count() == 0


def test_glob():
    cases = {"lib/**/*.ts": ["lib/one.ts", "lib/x/y/a.ts"], "*.ts": ["a.ts"], "a?.js": ["ab.js"]}
    for glob, yes in cases.items():
        assert all(re.search(reports.glob_pattern(glob), p) for p in yes) and not re.search(reports.glob_pattern(glob), "etc/x.py")


def test_virtual_graph_counts(spark):
    g = load(spark, "/root/testdata/sf0.001")
    assert g.nodes.count() == 200 and g.imports.count() == 266 and g.imports.where("is_external").count() == 24


def test_connected(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(80)] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = connected(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(999,), (None,)], "node int"))
    assert dict(map(tuple, got.collect())) == {x: find(x) for x in list(parent)} | {999: 999}

"""Steps that have to grow no faster than their input."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.parse import parse_table
from graphloom.operators import graph
from graphloom.plans import build, packed, traverse
from graphloom.plans.model import CodeGraph
from graphloom.plans.virtual import load


def jobs_of(spark, name, f):
    """What f returns, and the number of Spark jobs that it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def made_graph(spark, n, edges, tests=()):
    name = lambda i: f"f{i:03}"
    nodes = [{"node_seq": i, "path": name(i), "type": "typescript", "category": "test" if i in tests else "logic", "mtime": 0.0, "size": 1} for i in range(n)]
    imports = [{"path": name(a), "edge_seq": k, "to_path": name(b), "raw_specifier": "", "type": "static", "is_style": False, "is_external": False} for k, (a, b) in enumerate(edges)]
    return CodeGraph.from_rows(spark, nodes=nodes, imports=imports)


def after(edges, start):
    seen, todo = set(), [start]
    while todo:
        a = todo.pop()
        for x, y in edges:
            if x == a and y not in seen:
                seen.add(y)
                todo.append(y)
    return seen


def test_nodes_are_not_broadcast(spark):
    g = load(spark, "/root/testdata/sf0.001")
    for df in (g.internal(), g.exports, g.calls, graph.neighbours(g, "x").select("path", "type"), g.exports.join(g.nodes.select("path", "node_seq"), "path")):
        assert "BroadcastExchange" not in plan(df)


def test_a_long_ring_takes_few_jobs(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 120) for i in range(120)] + [(500, 0), (7, 600)], "src INT, dst INT")
    found, jobs = jobs_of(spark, "ring", lambda: traverse.strongly_connected(edges).groupBy("component").count().collect())
    assert [tuple(r) for r in found] == [(0, 120)] and jobs < 60
    found, jobs = jobs_of(spark, "reach", lambda: traverse.reach(edges, spark.createDataFrame([(500,)], "node INT")).agg(F.max("depth"), F.count("*")).first())
    assert tuple(found) == (120, 122) and jobs < 40


@pytest.mark.parametrize("in_task", [packed.IN_TASK, 0])
def test_walks_with_and_without_joins(spark, monkeypatch, in_task):
    monkeypatch.setattr(packed, "IN_TASK", in_task)
    rng = random.Random(in_task)
    edges = [(rng.randint(0, 24), rng.randint(0, 24)) for _ in range(34)]
    df = spark.createDataFrame([(f"n{a:02}", f"n{b:02}") for a, b in edges], "src STRING, dst STRING")
    up = {i: after(edges, i) for i in range(25)}
    want = {f"n{i:02}": f"n{min(j for j in up[i] if i in up[j]):02}" for i in range(25) if i in up[i]}
    assert dict(map(tuple, traverse.strongly_connected(df).collect())) == want
    seeds = {1: 9, 5: 3, 20: 4}
    best = {f"n{i:02}": min(r for s, r in seeds.items() if i == s or i in up[s]) for i in range(25) if any(i == s or i in up[s] for s in seeds)}
    assert dict(map(tuple, traverse.least_source(df, spark.createDataFrame([(f"n{s:02}", r) for s, r in seeds.items()], "node STRING, rank LONG")).collect())) == best
    stop = spark.createDataFrame([("n05",), ("n01",)], "node STRING")
    blocked = [e for e in edges if e[0] != 5]
    got = {r.node for r in traverse.reach(df, spark.createDataFrame([("n01",), (None,)], "node STRING"), stop=stop).collect()}
    assert got == {f"n{i:02}" for i in after(blocked, 1) | {1}}


@pytest.mark.parametrize("in_task", [packed.IN_TASK, 0])
def test_each_file_goes_to_its_least_hub_without_a_row_for_each_pair(spark, monkeypatch, in_task):
    monkeypatch.setattr(packed, "IN_TASK", in_task)
    rng = random.Random(4)
    edges = [(h, rng.randint(0, 39)) for h in (0, 7, 8, 30) for _ in range(7)] + [(rng.randint(0, 39), rng.randint(0, 39)) for _ in range(40)]
    edges = sorted({e for e in edges if e[0] != e[1]})
    degree = {a: sum(x == a for x, _ in edges) for a, _ in edges}
    hubs = {a for a, n in degree.items() if n >= 5}
    want = {}
    for i in set(range(40)) - hubs:
        over = [h for h in hubs if i in after(edges, h)]
        if over:
            want[f"f{i:03}"] = f"f{min(over, key=lambda h: (degree[h], h)):03}"
    assert want and dict(map(tuple, graph.feature_assignment(made_graph(spark, 40, edges)).collect())) == want


def test_files_of_one_partition_are_parsed_by_all_cores(spark):
    files = spark.range(400).select(F.concat(F.lit("a"), "id", F.lit(".py")).alias("path"), F.lit(0.0).alias("mtime"), F.lit(1).alias("size"), F.lit("import os\n").alias("content")).coalesce(1)
    each = [r["count"] for r in parse_table(files).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(each) == 400 and max(each) < 100


@pytest.mark.parametrize("in_task", [packed.IN_TASK, 0])
def test_blast_radius_of_every_file(spark, tmp_path, monkeypatch, in_task):
    monkeypatch.setattr(packed, "IN_TASK", in_task)
    rng = random.Random(11)
    edges = [(rng.randint(0, 29), rng.randint(0, 29)) for _ in range(36)] + [(31, 32), (32, 33), (33, 32), (34, 33), (32, 35), (35, 36), (37, 36), (38, 38)]
    g = made_graph(spark, 40, edges)
    name = lambda i: f"f{i:03}"
    want = {(name(i), name(a)) for a in range(40) for i in after(edges, a) if a != i}
    pairs = [(r.path, r.affected) for r in graph.impact_pairs(g).collect()]
    assert len(pairs) == len(want) and set(pairs) == want
    kept = graph.build_impact(g)
    kept.save(str(tmp_path / "impact"))
    for impact in (kept, graph.load_impact(spark, str(tmp_path / "impact"))):
        for i in (0, 3, 17, 32, 33, 36, 38, 39):
            assert sorted(r.path for r in impact.lookup(name(i)).collect()) == sorted(a for p, a in want if p == name(i)), i


def test_files_behind_a_cycle_share_what_depends_on_it(spark):
    edges = [(i, (i + 1) % 20) for i in range(20)] + [(5, 20), (20, 21), *((21, i) for i in range(22, 40))]
    radius = graph.build_impact(made_graph(spark, 40, edges)).radius
    assert radius.select(F.sum(F.size("affected"))).first()[0] < 70, "780 pairs without sharing"


def test_candidates_are_found_once_and_plain(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(build, "cut", lambda df, real=build.cut: (calls.append(plan(df)), real(df))[1])
    rows = [("a/b", s) for s in ("./x", "../x", "../../../x", "./", ".", "..", "./y/../x", "/x", "a//x", "x/.", "../a/b/..")]
    asked = spark.createDataFrame([(f, "script", s, False) for f, s in rows], "folder STRING, bucket STRING, specifier STRING, is_style BOOLEAN")
    candidates = {(r.specifier, r.candidate) for r in build._candidates(asked, build.BuildOptions()).collect()}
    bases = {s: f"a/b/{s}" if s.startswith(".") else s for _, s in rows}
    want = set()
    for s, base in bases.items():
        for tail in build.PROBES["script"]:
            out = []
            for part in (base + tail).split("/"):
                if part == ".." and not out:
                    out = [".."]
                elif part == "..":
                    out.pop()
                elif part not in ("", "."):
                    out.append(part)
            if ".." not in out and out:
                want.add((s, "/".join(out)))
    assert candidates == want
    files = spark.createDataFrame([("a/b/x.ts",), ("a/x/index.ts",)], "path STRING")
    got = {r.specifier: r.to_path for r in build.resolve(asked, files).collect() if not r.is_external}
    assert got == {"./x": "a/b/x.ts", "./y/../x": "a/b/x.ts", "../x": "a/x/index.ts", "a//x": "a/x/index.ts"}
    assert sum("Generate" in p for p in calls) == 1, "candidates are made once"

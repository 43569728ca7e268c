import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import hnsw, queries


def clustered(n, seed=0, dim=32):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dim))
    v = centers[rng.integers(0, 8, n)] * 0.7 + rng.normal(size=(n, dim))
    return v.astype(np.float32)


def test_graph_recall_and_packing():
    v = clustered(3000)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = hnsw.Graph.unpack(*hnsw.build(v).pack().values())
    ids, d = g.search(v, 11)
    want = hnsw.exact_neighbours(v, 10)
    assert np.mean([len((set(a.tolist()) - {i}) & set(b.tolist())) for i, (a, b) in enumerate(zip(ids, want))]) / 10 > 0.93
    assert (np.diff(d, axis=1) >= 0).all() and all(x.min() >= -1 for x in g.links)
    for n in (1, 2, 3, 17):
        small, _ = hnsw.build(v[:n]).search(v[:n], 5)
        assert ((small >= 0).sum(axis=1) == min(n, 5)).all(), "small graphs are searched whole"


def test_merged_shards_and_edge_cases(spark):
    v = clustered(1200, 5, 16)
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    odd = [(5000, None, 0), (5001, [], 0), (5002, [1.0, 2.0], 0), (5003, [0.0] * 16, 0), (5004, [float("nan")] * 16, 0), (5005, [None] * 16, 0), (None, v[0].tolist(), 0), (0, v[0].tolist(), 0), (5006, v[3].tolist(), 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, id int")
    got = {}
    for r in hnsw.nearest_neighbours(df, 5, shard_rows=400).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbour, r.similarity))
    assert set(got) == set(range(1200)) | {5006} and all(len(x) == 5 for x in got.values())
    want = hnsw.exact_neighbours(np.vstack([v, v[3:4]]), 5)
    name = lambda i: 5006 if i == 1200 else i
    assert np.mean([len({n for n, _ in got[i]} & {name(j) for j in want[i].tolist()}) for i in range(1200)]) / 5 > 0.9
    assert got[3][0][0] == 5006 and got[5006][0][0] == 3 and all(i not in {n for n, _ in x} for i, x in got.items())
    some = {}
    for r in hnsw.nearest_neighbours(df, 5, shard_rows=400, queries=F.col("id") % 100 == 0).orderBy("id", "rank").collect():
        some.setdefault(r.id, []).append((r.neighbour, r.similarity))
    assert some == {i: x for i, x in got.items() if i % 100 == 0}, "a query's answer doesn't depend on the others"
    assert hnsw.nearest_neighbours(df.limit(0)).count() == 0
    assert hnsw.nearest_neighbours(df.where("vec_id = 4")).count() == 0


def test_registered_query_recall_and_plan(spark):
    """The stated query set over all rows of the 0.01 table, against brute force."""
    folder = "/root/testdata/sf0.01"
    made = queries.op3_nearest_neighbours(spark, folder)
    assert "CartesianProduct" not in (plan := made._jdf.queryExecution().toString()) and "BroadcastNestedLoop" not in plan
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)
    want = hnsw.exact_neighbours(v, 10)
    got = {}
    for r in made.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    asked = [i for i, x in enumerate(ids) if x % 100 == 0]
    assert set(got) == {int(ids[i]) for i in asked} and all(len(x) == 10 for x in got.values())
    assert np.mean([len(set(got[int(ids[i])]) & set(ids[want[i]].tolist())) for i in asked]) / 10 >= 0.93

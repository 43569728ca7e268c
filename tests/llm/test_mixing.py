import collections
import hashlib
import random

from graphloom.llm import mixing


def fill(sizes, weights, cap, budget):
    """Clamp, redistribute, repeat."""
    live = {s: w for s, w in weights.items() if w > 0 and sizes[s] > 0}
    out, rest = dict.fromkeys(sizes, 0.0), float(budget)
    while live:
        total = sum(live.values())
        over = [s for s, w in live.items() if rest * w / total > cap * sizes[s] * (1 + 1e-12)]
        if not over:
            for s, w in live.items():
                out[s] = rest * w / total / sizes[s]
            return out
        for s in over:
            out[s] = cap
            rest -= cap * sizes[s]
            del live[s]
        rest = max(rest, 0.0)
    return out


def test_water_filling_matches_the_loop(spark):
    rng = random.Random(1)
    for trial in range(6):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 50, 500, 5000]) for i in range(rng.randint(1, 12))}
        weights = {s: rng.choice([0, 1, 1, 2, 10]) for s in sizes}
        budget = rng.choice([None, 10, 10**6])
        df = spark.createDataFrame([(s, n, float(weights[s])) for s, n in sizes.items()], "source string, size long, weight double")
        got = {r.source: r.epochs for r in mixing.water_fill(df, 3.0, budget=budget).collect()}
        want = fill(sizes, weights, 3.0, sum(sizes.values()) if budget is None else budget)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want), (sizes, weights, budget, got, want)


def test_copies_follow_epochs(spark):
    rows = [(i, "x" * 10, s) for i, s in enumerate(["big"] * 900 + ["small"] * 30 + [None] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {"big": 9000, "small": 300, None: 600}
    want = fill(sizes, {s: n**0.5 for s, n in sizes.items()}, 4.0, 9900)
    out = mixing.mix_documents(docs, 4.0, 0.5).collect()
    seen = collections.Counter(r.doc_id for r in out)
    for i, _, s in rows:
        draw = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:12], 16) / 2**48
        assert seen[i] == int(want[s]) + (draw < want[s] - int(want[s]))
    assert all(sorted(r.copy for r in out if r.doc_id == i) == list(range(seen[i])) for i in (0, 905, 950))
    assert want["small"] == 4.0 and all(seen[i] == 4 for i in range(900, 930))


def test_edge_cases(spark):
    rows = [(1, "aaaa", "s"), (1, "aaaa", "s"), (None, "bb", "s"), (3, None, "t"), (4, "", "t"), (5, "y" * 100000, "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.withColumn("copy", docs.doc_id).withColumn("epochs", docs.source)
    out = mixing.mix_documents(docs, copy_col="n")
    assert out.columns == [*docs.columns, "n"]
    seen = collections.Counter(r.doc_id for r in out.collect())
    assert 3 not in seen and 4 not in seen, "a source without text is left out"
    assert seen[1] % 2 == 0, "repeated rows are drawn alike"
    assert mixing.mix_documents(docs.limit(0), copy_col="n").count() == 0
    many = mixing.BROADCAST_SOURCES
    try:
        mixing.BROADCAST_SOURCES = 0
        assert collections.Counter(r.doc_id for r in mixing.mix_documents(docs, copy_col="n").collect()) == seen, "the shuffled join gives the same"
    finally:
        mixing.BROADCAST_SOURCES = many

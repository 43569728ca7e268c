import random
import re

import numpy as np
import pyarrow as pa

from graphloom.llm import sketch


def shingles(t, k=5):
    w = re.findall(r"[0-9a-z]+", (t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def texts(seed=1, n=12):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 3000)}" for _ in range(900)]
    out = []
    for i in range(n):
        words = list(base[: 900 - 60 * i])
        for _ in range(5 * i):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
        out.append(" ".join(words))
    return out


def parts(ts, k=64):
    values, at, n = sketch.sketches(pa.array(ts), k)
    return [values[a:b] for a, b in zip(at, at[1:])], n


def test_counts_order_and_merge():
    ts = [*texts(), "", None, "one two", "a b c d e", "a b c d e " * 50]
    own, n = parts(ts)
    assert n.tolist() == [len(shingles(t)) for t in ts]
    everything, _ = parts(ts, 10**6)
    for s, e in zip(own, everything):
        assert s.tolist() == sorted(e.tolist())[:64]
    assert sketch.merge(own[:5]).tolist() == sorted(set().union(*(e.tolist() for e in everything[:5])))[:64]
    assert sketch.merge([]).tolist() == []


def test_estimates_are_near_the_truth():
    ts = texts()
    own, n = parts(ts, 256)
    sets = [shingles(t) for t in ts]
    for i in range(len(ts)):
        assert abs(sketch.estimate_distinct(own[i], 256) / n[i] - 1) < 0.3
        for j in range(len(ts)):
            a, b = sets[i], sets[j]
            assert abs(sketch.estimate_resemblance(own[i], own[j], 256) - len(a & b) / len(a | b)) < 0.12
            assert abs(sketch.estimate_containment(own[i], own[j], 256) - len(a & b) / len(a)) < 0.2
    none = np.zeros(0, np.int64)
    assert sketch.estimate_resemblance(none, own[0]) == sketch.estimate_containment(own[0], none) == 0.0


def test_tables(spark):
    ts = texts()
    rows = [*[(i, t, "ab"[i % 2]) for i, t in enumerate(ts)], (50, None, "a"), (51, "", None), (None, ts[0], "b"), (0, ts[0], "a"), (52, "z " * 50000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch string")
    bench = spark.createDataFrame([(1, ts[0]), (2, "unrelated words of a benchmark item here")], "item_id long, text string")
    got = {}
    for r in sketch.fingerprints(docs, bench).collect():
        got.setdefault(r.doc_id, r)
    own, _ = parts(ts)
    assert all(got[i].sketch == own[i].tolist() for i in range(len(ts)))
    assert got[0].containment == 1.0 and got[0].resemblance > 0.9 and got[50].sketch == [] and got[51].n_shingles == 0.0
    assert sketch.fingerprints(docs.limit(0), bench).count() == 0
    assert all(r.containment == 0 for r in sketch.fingerprints(docs, bench.limit(0)).collect())
    tagged = sketch.sketch_table(docs.withColumnRenamed("sketch", "source"), "doc_id", "text", 64, 5, "source")
    merged = {r.source: r.sketch for r in sketch.merge_by(tagged, "source").collect()}
    everything, _ = parts([r[1] for r in rows])
    for key in ("a", "b", None):
        assert merged[key] == sketch.merge([e for e, r in zip(everything, rows) if r[2] == key]).tolist()


def test_items_are_told_apart_and_found_in_long_documents(spark):
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    items = [" ".join(words(30)) for _ in range(6)] + [" ".join(words(9000)), "two words", "", None]
    long = words(4000)
    docs = [" ".join([*long[:2500], *items[0].split(), *long[2500:]]), items[1], " ".join(items[2].split()[:20]), " ".join(items[6].split()[4000:4100]), "two words", " ".join(words(50)), "", None, items[3] + " " + items[3] + " " + items[4]]
    bench = spark.createDataFrame([*enumerate(items), (5, items[0])], "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    of_item = {i: shingles(t) | (shingles(items[0]) if i == 5 else set()) for i, t in enumerate(items)}
    everything = set().union(*of_item.values())
    got = {r.doc_id: r for r in sketch.fingerprints(table, bench).collect()}
    assert len(got) == len(docs)
    for d, t in enumerate(docs):
        own = shingles(t)
        want = [(i, len(own & x), round(len(own & x) / len(own | x), 6), round(len(own & x) / len(own), 6), round(len(own & x) / len(x), 6)) for i, x in of_item.items() if own & x]
        assert [tuple(m) for m in got[d].matches] == want
        assert got[d].containment == round(len(own & everything) / max(len(own), 1), 6)
        assert got[d].resemblance == round(len(own & everything) / len(own | everything), 6)
    assert got[0].matches[0].item_containment == 1.0 and got[3].containment == 1.0
    assert all(r.matches == [] for r in sketch.fingerprints(table, bench.limit(0)).collect())

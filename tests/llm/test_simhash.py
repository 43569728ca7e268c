import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.llm import simhash
from graphloom.llm import text as tx


def brute_print(text, turn=0):
    words = tx.Words(tx.lower(tx.clean(pa.array([text]))))
    hs = {(int(h) >> 16) ^ turn for h in words.hash}
    if not hs:
        return None
    votes = [sum(1 if tx.mix_one(h) >> b & 1 else -1 for h in hs) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_fingerprints_match_brute_force():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 900))) for _ in range(12)] + ["", None, "...", "Solo", " ".join(f"w{i}" for i in range(700))]
    fp, fp2, there = simhash.fingerprints(pa.array(texts))
    assert [int(f) if t else None for f, t in zip(fp2, there)] == [brute_print(t, int(simhash._SECOND)) if t else None for t in texts]
    assert [int(f) if t else None for f, t in zip(fp, there)] == [brute_print(t) if t else None for t in texts]
    alone = [simhash.fingerprints(pa.array([t]))[0][0] for t in texts if t]
    assert alone == [f for f, t in zip(fp, texts) if t], "the slice a text is in doesn't matter"


def test_pairs_are_all_pairs_within_the_distance(spark):
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(40):
        center = int(rng.integers(0, 2**63)) | int(rng.integers(0, 2**63)) << 64
        fps.add(center)
        for _ in range(6):
            bits = [*rng.choice(64, int(rng.integers(0, 12)), replace=False), *(64 + rng.choice(64, int(rng.integers(0, 20)), replace=False))]
            fps.add(center ^ sum(1 << int(b) for b in bits))
    signed = lambda x: int(np.array([x & (2**64 - 1)], np.uint64).view(np.int64)[0])
    all_ = sorted(fps)
    nodes = spark.createDataFrame([(i, signed(f), signed(f >> 64)) for i, f in enumerate(all_)], "rep long, fp long, fp2 long")
    for d, whole in ((8, 22), (3, 9), (0, 12)):
        apart = [(i, j, x ^ y) for i, x in enumerate(all_) for j, y in enumerate(all_) if i < j]
        want = sorted((i, j, z.bit_count()) for i, j, z in apart if (z & (2**64 - 1)).bit_count() <= d and z.bit_count() <= whole)
        assert want and sorted(map(tuple, simhash.pairs(nodes, d, whole).collect())) == want


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in parent if find(x) != x}
    got = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, got.collect())) == want


def near(rng, words, edits):
    words = list(words)
    for i in rng.sample(range(len(words)), edits):
        words[i] += "x"
    return " ".join(words)


def test_groups_and_edge_cases(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    other = [f"v{rng.randint(0, 5000)}" for _ in range(200)]
    rows = [(10, " ".join(base), 1), (11, " ".join(base), 2), (12, near(rng, base, 3), 3), (13, near(rng, base, 2).upper(), 4), (20, " ".join(other), 5), (21, "", 6), (22, "", 7), (23, None, 8), (24, "?!", 9), (25, None, None), (30, "alone here", 1), (30, "alone here", 1), (None, "alone here", 1), (None, None, None), (40, " ".join(other * 400), 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `fp` long")
    docs = docs.withColumns({c: F.col("fp") for c in ("__gone", "group_id", "gone_id", "key_of_id", "row_of_id")})
    found = simhash.near_duplicates(docs).collect()
    links = {r.doc_id: r.links for r in found}
    assert links[10] == links[11] and 0 < links[10] <= 2 and links[20] == links[21] == links[30] == 0
    got = {r.doc_id: (r.group_id, r.keep) for r in found}
    assert got == {10: (10, True), 11: (10, False), 12: (10, False), 13: (10, False), 20: (20, True), 40: (20, False), 21: (21, True), 22: (22, True), 23: (23, True), 24: (24, True), 25: (25, True), 30: (30, True)}
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r[0] or -1) for r in left.collect()) == [-1, -1, 10, 20, 21, 22, 23, 24, 25, 30]
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").union(spark.createDataFrame([("not a number", " ".join(base))], "a string, b string"))
    assert {r.doc_id for r in simhash.near_duplicates(named).collect()} == set(got)
    assert simhash.drop_near_duplicates(named).count() == left.count() + 1
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).columns == docs.columns


def test_either_half_finds_near_pairs(spark):
    rng = np.random.default_rng(8)
    fps = set()
    for _ in range(40):
        center = int(rng.integers(0, 2**63)) | int(rng.integers(0, 2**63)) << 64
        fps.add(center)
        for most in (8, 16, 24, 26):
            for part in (slice(0, 64), slice(64, 128), slice(0, 128)):
                bits = rng.choice(np.arange(128)[part], int(rng.integers(1, most)), replace=False)
                fps.add(center ^ sum(1 << int(b) for b in bits))
    signed = lambda x: int(np.array([x & (2**64 - 1)], np.uint64).view(np.int64)[0])
    all_ = sorted(fps)
    nodes = spark.createDataFrame([(i, signed(f), signed(f >> 64)) for i, f in enumerate(all_)], "rep long, fp long, fp2 long")
    blocks = [((1 << w) - 1) << (64 * half + s) for half in (0, 1) for s, w in simhash.BLOCKS]
    apart = [(i, j, x ^ y) for i, x in enumerate(all_) for j, y in enumerate(all_) if i < j and (x ^ y).bit_count() <= 22]
    want = [(i, j, z.bit_count()) for i, j, z in apart if any((z & b).bit_count() <= 2 for b in blocks)]
    got = sorted(map(tuple, simhash.near_pairs(nodes).collect()))
    assert got == want
    surely = {(i, j) for i, j, z in apart if z.bit_count() <= 17 or min((z & (2**64 - 1)).bit_count(), (z >> 64).bit_count()) <= 8}
    assert surely <= {(i, j) for i, j, _ in got} and len(surely) > len([1 for _, _, z in apart if (z & (2**64 - 1)).bit_count() <= 8])


def test_texts_near_by_the_second_half_are_grouped(spark):
    rng = random.Random(2)
    found = None
    while not found:
        words = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
        two = [" ".join(words), near(rng, words, 4)]
        fp, fp2, _ = simhash.fingerprints(pa.array(two))
        first, second = int(fp[0] ^ fp[1]).bit_count(), int(fp2[0] ^ fp2[1]).bit_count()
        found = two if first > 8 and second <= 8 and first + second <= 22 else None
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    assert {r.doc_id: r.group_id for r in simhash.near_duplicates(docs).collect()} == {0: 0, 1: 0}


def spread(z):
    """Whether differing bits are 22 at most, but 3 or more in each of the blocks of near_pairs."""
    blocks = [((1 << w) - 1) << (64 * half + s) for half in (0, 1) for s, w in simhash.BLOCKS]
    return z.bit_count() <= 22 and all((z & b).bit_count() > 2 for b in blocks)


def test_texts_that_differ_in_every_block_are_grouped(spark):
    rng = random.Random(4)
    found = None
    while not found:
        words = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
        two = [" ".join(words), near(rng, words, 4)]
        fp, fp2, _ = simhash.fingerprints(pa.array(two))
        found = two if spread(int(fp[0] ^ fp[1]) | int(fp2[0] ^ fp2[1]) << 64) else None
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    assert {r.doc_id: (r.group_id, r.links) for r in simhash.near_duplicates(docs).collect()} == {0: (0, 1), 1: (0, 1)}


def test_every_pair_is_found_by_any_layout_and_over_chunks(spark):
    rng = np.random.default_rng(6)
    prints = []
    for center in rng.integers(0, 2**63, (40, 2)).astype(np.uint64).tolist():
        for _ in range(12):
            bits = rng.choice(128, int(rng.integers(0, 20)), replace=False).tolist()
            prints.append([c ^ sum(1 << (b % 64) for b in bits if b // 64 == half) for half, c in enumerate(center)])
    both = np.unique(np.array(prints, np.uint64), axis=0).T.copy()
    all_ = [x | y << 64 for x, y in zip(*both.tolist())]
    apart = [(i, j, x ^ y) for i, x in enumerate(all_) for j, y in enumerate(all_) if i < j]
    assert sum(spread(z) for _, _, z in apart) > 20
    for whole in (0, 3, 22):
        want = sorted((i, j, z.bit_count()) for i, j, z in apart if z.bit_count() <= whole)
        seen = set()
        for n in (2, 10**4, 10**5, 10**6):
            blocks = simhash._layout(n, whole)
            seen.add(len(blocks))
            got = [x for k in range(len(blocks)) for part in simhash._search(both, None, whole, blocks, k) for x in zip(*(y.tolist() for y in part))]
            assert sorted((min(i, j), max(i, j), d) for i, j, d in got) == want
    assert seen == {1, 12, 8, 6}
    nodes = spark.createDataFrame([(7 * i, *x) for i, x in enumerate(both.T.view(np.int64).tolist())], "rep long, fp long, fp2 long")
    for chunk in (1000, 300, 60):
        assert sorted(map(tuple, simhash.every_pair(nodes, chunk=chunk).collect())) == [(7 * i, 7 * j, d) for i, j, d in want]
    assert simhash.every_pair(nodes.limit(0)).count() == simhash.every_pair(nodes.limit(1)).count() == 0


def test_a_crowded_block_is_searched_in_steps(monkeypatch):
    monkeypatch.setattr(simhash, "STEP", 500)
    rng = np.random.default_rng(7)
    # one value in the first block, so all are candidates of all
    both = np.unique(rng.integers(0, 2**63, (300, 2)).astype(np.uint64) & np.array([0xF0000, 0xFFFFF], np.uint64), axis=0).T.copy()
    blocks = simhash._layout(10**5, 22)
    want = np.triu(np.bitwise_count(both[0][:, None] ^ both[0]) + np.bitwise_count(both[1][:, None] ^ both[1]) <= 22, 1).sum()
    assert want == sum(len(i) for k in range(len(blocks)) for i, _, _ in simhash._search(both, None, 22, blocks, k))

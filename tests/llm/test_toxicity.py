import random
import tracemalloc

import numpy as np
import pyarrow as pa

from graphloom.llm import toxicity
from graphloom.llm import text as tx


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    syllables = ["ba", "ro", "ti", "mel", "son", "da", "ker", "li"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vilgrub", "hadscor"]) + rng.choice(["", "s", "ing"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_accuracy():
    rows = corpus()
    model = toxicity.fit(pa.array([r[1] for r in rows[:400]]), np.array([r[2] for r in rows[:400]]))
    z = model.logits(pa.array([r[1] for r in rows[400:]]))
    assert np.mean((z >= model.threshold) == np.array([r[2] for r in rows[400:]])) > 0.97
    assert model.logits(pa.array(["", None]))[0] == model.bias


def test_logits_match_brute_force():
    model = toxicity.Model(np.random.default_rng(0).random(1 << toxicity.BITS).astype(np.float32), 0.5, 0.0)
    text = "Ab abc ab ÜBER"
    want = 0.5
    for w in {"ab", "abc", "über"}:
        raw = b" " + w.encode() + b" "
        for n in toxicity.SIZES:
            for i in range(len(raw) - n + 1):
                gram = raw[i : i + n]
                h = sum((b + 1) * pow(tx._BASE, j, 1 << 64) for j, b in enumerate(gram)) + n & (2**64 - 1)
                want += model.weight[tx.mix_one(h) >> (64 - toxicity.BITS)]
    assert np.isclose(model.logits(pa.array([text, "x"]))[0], want, atol=1e-4)


def test_training_and_edge_cases(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([*[(i, t, "a") for i, t, _ in rows], (None, "no id", "b"), (900, None, "c"), (901, "", "d"), (902, "vilgrubs " * 30000, "e"), (903, "meldaker", "f"), (0, rows[0][1], "a")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([*[(i, b, 1) for i, _, b in rows], (0, 0, 1), (None, 1, 1), (5, None, 1), (77777, 1, 1)], "doc_id long, toxic int, text int")
    model = toxicity.train(docs, labels)
    got = {}
    for r in toxicity.score(docs, model).collect():
        got.setdefault(r.doc_id, r.toxic)
    assert np.mean([got[i] == bool(b) for i, _, b in rows]) > 0.97
    assert got[902] and not got[900] and not got[901] and not got[None]
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and not {0, 902} & {r.doc_id for r in kept.collect()}
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.drop_toxic(docs, nothing).count() == docs.count(), "without labels nothing is toxic"


def test_fit_counts_in_blocks():
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = np.array(["".join(x) for x in letters[rng.integers(0, 26, (500_000, 8))]]).reshape(1000, 500)
    column, toxic = pa.array([" ".join(x) for x in words]), rng.integers(0, 2, 1000)
    grams = len(toxicity._vocabulary(column)[2])
    tracemalloc.start()
    toxicity.fit(column, toxic, rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 17 bytes an n-gram; with a wide copy of its bucket and of its word's count it was 26
    assert grams > 10_000_000 and peak < 22 * grams

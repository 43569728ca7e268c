import random
import re

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import licenses
from graphloom.llm import text as tx


def ordinary(n=300, seed=1):
    rng = random.Random(seed)
    words = ["the", "of", "house", "river", "under", "license", "public", "version", "work", "green", "right", "all", "tree"] + [f"w{i}" for i in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(3, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return licenses.fit(ordinary())


def brute_units(text):
    """[(start, stop)] over the text's words, and each word's line and paragraph."""
    words, line_of, paragraph_of, paragraph, gap = [], [], [], -1, True
    for number, line in enumerate(text.lower().split("\n")):
        own = re.findall(r"[0-9a-z\x80-\U0010ffff]+", line)
        if own and gap:
            paragraph += 1
        gap = not own
        words += own
        line_of += [number] * len(own)
        paragraph_of += [paragraph] * len(own)
    found = []
    for p in range(paragraph + 1):
        a, b = paragraph_of.index(p), len(words) - paragraph_of[::-1].index(p)
        lines = sorted(set(line_of[a:b]))
        for x in lines:
            i, j = line_of.index(x), len(words) - line_of[::-1].index(x)
            found += [(i, j)] * (j - i <= 64)
        found += [(a, b)] * (len(lines) > 1 and b - a <= 64)
        for size in licenses.WINDOWS:
            if b - a > size:
                at = a
                while at + size < b:
                    found.append((at, at + size))
                    at += size // 2
                found.append((b - size, b))
    return words, sorted(found), line_of, paragraph_of


def brute_probabilities(words, span, model):
    z, n = np.zeros(len(model.names)), 0
    row = {b: i for i, b in enumerate(model.used.tolist())}
    for k in licenses.GRAMS:
        before = None
        for i in range(span[0], span[1] - k + 1):
            # repeats are told over the whole text
            bucket = gram_bucket(words[i : i + k])
            before = gram_bucket(words[i - 1 : i - 1 + k]) if i else None
            if bucket != before and bucket in row:
                z += model.weight[row[bucket]]
                n += 1
    z = (z / np.sqrt(max(n, 1)) + model.bias) / model.temperature
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def gram_bucket(words):
    out = 0
    for w in words:
        h = tx.mix_one(sum((b + 1) * pow(tx._BASE, j, 1 << 64) for j, b in enumerate(w.encode())))
        out = (out * tx._BASE + h) & (2**64 - 1)
    return tx.mix_one(out + len(words)) >> (64 - licenses.BITS)


def texts(seed=3):
    rng = random.Random(seed)
    stock, out = ordinary(80, seed), ["", "\n\n", "one", "-- \n\nMIT\n \nlicense", "word word word word"]
    for ts in list(licenses.TEMPLATES.values())[::2]:
        for t in ts[:2]:
            w = t.split()
            out.append(rng.choice(stock) + "\n\n" + "\n".join(" ".join(w[i : i + 7]) for i in range(0, len(w), 7)) + "\n" + rng.choice(stock))
            out.append(" ".join([*" ".join(rng.sample(stock, 3)).split(), *w, *rng.choice(stock).split()]))
    return out


def test_units_and_scores_match_brute_force(model):
    own = texts()
    words = tx.Words(tx.lower(pa.array(own)))
    start, stop, line, paragraph = licenses.units(words)
    got = model.probabilities(words.hash, start, stop)
    first, at = words.first.tolist(), 0
    for i, t in enumerate(own):
        names, want, line_of, paragraph_of = brute_units(t)
        assert line[first[i] : first[i + 1]].tolist() == line_of and paragraph[first[i] : first[i + 1]].tolist() == paragraph_of
        there = [(a - first[i], b - first[i]) for a, b in zip(start[at : at + len(want)].tolist(), stop[at : at + len(want)].tolist())]
        assert there == want
        for span, p in list(zip(want, got[at : at + len(want)]))[:: 1 if len(want) < 20 else 5]:
            assert span[0] == 0 or np.allclose(p, brute_probabilities(names, span, model), atol=1e-4)
        at += len(want)
    assert at == len(start)


def test_chunks_don_t_matter(model, monkeypatch):
    column = pa.array(texts(5))
    whole = licenses.claims(column, model)
    monkeypatch.setattr(licenses, "CHUNK", 3)
    assert licenses.claims(column, model) == whole and whole
    assert [licenses.claims(pa.array([t]), model) for t in texts(5)] == [[(0, *c[1:]) for c in whole if c[0] == i] for i in range(len(column))]


def test_unseen_templates_and_paragraphs(model):
    assert model.accuracy > 0.4, "wordings that the fit has never seen are the most of it"
    examples = licenses._examples(ordinary(), 5)
    held = licenses.held_out(examples)
    assert not {s for (_, _, s), h in zip(examples, held) if h} & {s for (_, _, s), h in zip(examples, held) if not h}
    assert 0.1 < held.mean() < 0.5 and len({y for (_, y, _), h in zip(examples, held) if h}) > 8
    fresh = [p for p in ordinary(400, 99)]
    assert np.mean([bool(c) for c in (licenses.claims(pa.array([p]), model) for p in fresh)]) < 0.03


@pytest.mark.parametrize("shape", ["line", "wrapped", "long line"])
def test_templates_are_found(model, shape):
    rng, found = random.Random(7), []
    for family, ts in licenses.TEMPLATES.items():
        for t in ts:
            w = t.split()
            if shape == "line":
                text = "Some story.\n" + t + "\nThe end."
            elif shape == "wrapped":
                text = "Some story here.\n\n" + "\n".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6)) + "\n\nThe end."
            else:
                text = " ".join([*" ".join(rng.sample(ordinary(), 10)).split(), *w, *" ".join(rng.sample(ordinary(), 12)).split()])
            found.append([c[2] for c in licenses.claims(pa.array([text]), model) if c[6]] == [family])
    assert np.mean(found) > (0.9 if shape != "long line" else 0.85)


def test_similarity():
    assert licenses.similarity("licensed under the apache license, version 2.0.", "apache-2.0") == 1.0
    assert licenses.similarity("a green house", "mit") == 0.0 and licenses.similarity("", "mit") == 0.0
    assert licenses.similarity("all rights reserved", "no such family") == 0.0


def test_scan(spark, model):
    rows = [(1, "Some story.\n\nReleased under the MIT License.\nThe end of the story"), (2, ordinary()[0]), (3, None), (4, ""), (None, "All rights reserved."), (1, "Some story.\n\nReleased under the MIT License.\nThe end of the story"), (5, "x y\n" * 20000 + "This work is licensed under the GNU General Public License, version 3."), (6, "\n\n\n"), (7, "Licensed under CC BY-NC 4.0.\n\nLicensed under CC BY-NC 4.0.\n\nReleased under the Unlicense.")]
    docs = spark.createDataFrame([(t, i, 1, "x") for i, t in rows], "text string, doc_id long, family int, line string")
    got = sorted(((r.doc_id or -1), r.paragraph, r.line, r.family, r.confirmed) for r in licenses.scan(docs, model).collect())
    assert got == [(-1, 0, 0, "all-rights-reserved", True), (1, 1, 2, "mit", True), (1, 1, 2, "mit", True), (5, 0, 20000, "gpl", True), (7, 0, 0, "cc-by-nc", True), (7, 1, 2, "cc-by-nc", True), (7, 2, 4, "unlicense", True)]
    assert licenses.scan(docs.limit(0), model).count() == 0
    trained = licenses.train(docs.union(docs))
    assert "gpl" in [r.family for r in licenses.scan(docs.where("doc_id = 5"), trained).collect()]
    assert licenses.train(docs.limit(0)).names == model.names

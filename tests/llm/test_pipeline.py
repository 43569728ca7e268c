"""The five stages and run() against a version in plain Python, over nulls, empties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from graphloom.llm import langid, mixing, pieces, simhash, toxicity
from graphloom.llm import text as tx

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "__gone", "copy", "group_id"]
DDL = "doc_id long, text string, lang string, source string, n_chars long, __gone long, copy int, group_id string"
VOICES = {"en": "the river house green tree walks under bright morning window garden people speak about weather", "de": "der fluss haus grüner baum geht unter heller morgen fenster garten leute sprechen über wetter", "fr": "la rivière maison vert arbre marche sous clair matin fenêtre jardin gens parlent du temps"}


def fixture():
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(240):
        lang = "en de fr".split()[i % 3]
        words = [rng.choice(VOICES[lang].split()) + (str(rng.randint(0, 99)) if rng.random() < 0.3 else "") for _ in range(rng.randint(25, 90))]
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["vilgrub", "hadscor"]) + rng.choice(["", "s"])
        rows.append((i, " ".join(words), lang, "web" if i % 4 else "books"))
        labels.append((i, int(bad)))
    for i in range(60):  # near and exact copies, in one large group and small ones
        base = rows[rng.choice([1, 2, 4, 7, 1, 1])]
        words = base[1].split()
        if i % 3:
            words[rng.randrange(len(words))] = f"x{i}"
        rows.append((300 + i, " ".join(words), base[2], "forum"))
    rows += [rows[3], rows[3], (3, rows[8][1], "fr", "web"), (400, None, "en", "web"), (401, "", "de", None), (402, "?! ...", "en", "web"), (403, "qzxj wvkq xxzq jqkz zzqx " * 4, None, "web")]
    rows += [(None, rows[5][1] + " lost", "fr", "web"), (None, rows[1][1], "de", None), (None, None, None, None), (404, rows[6][1] + " " + "endless morning window " * 3000, "en", "books"), (405, VOICES["en"] + " naïve 好 \x00 a▁b  two", "en", None), (-7, VOICES["de"], None, "rare")]
    rng.shuffle(rows)
    return [(*r, None if r[1] is None else len(r[1]), r[0], 5, "g") for r in rows], labels


def words_of(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())


# ---- language: proportions of the mixture, set by BIC


def em(chance, start, rounds):
    shares = start
    for _ in range(rounds):
        r = chance * shares
        shares = (r / np.maximum(r.sum(axis=1, keepdims=True), 1e-30)).mean(axis=0)
    return shares, float(np.log(np.maximum((chance * shares).sum(axis=1), 1e-30)).sum())


def known_share(text, model):
    words = words_of(text)
    if not words:
        return None
    like = np.empty((len(words), len(model.names) + 1))
    for w, word in enumerate(words):
        raw = [32, 32] + [48 if 48 <= b <= 57 else b for b in word] + [32]
        like[w, -1] = (len(raw) - 2) * model.unknown
        two = [raw[j - 2] << 8 | raw[j - 1] for j in range(2, len(raw))]
        three = [t << 8 | raw[j + 2] for j, t in enumerate(two)]
        tri = [(t * 2654435761 & 0xFFFFFFFF) >> (32 - langid.TRI_BITS) for t in three]
        bi = [(t * 2246822519 & 0xFFFFFFFF) >> (32 - langid.BI_BITS) for t in two]
        like[w, :-1] = [sum(float(model.tri[i][a]) - float(model.bi[i][b]) for a, b in zip(tri, bi)) for i in range(len(model.names))]
    chance = np.exp(like - like.max(axis=1, keepdims=True))
    n, parts = chance.shape
    shares, fit = em(chance, np.full(parts, 1 / parts), 6)
    price = model.penalty / 2 * math.log(max(n, 2))
    active = (shares * n >= 0.5) | (shares == shares.max())
    score, best = fit - price * active.sum(), shares * active / (shares * active).sum()
    while (best > 0).sum() > 1:
        trial = best.copy()
        trial[min((x, i) for i, x in enumerate(best) if x > 0)[1]] = 0
        trial, fit = em(chance, trial / trial.sum(), 0 if (trial > 0).sum() == 1 else langid.EM_ROUNDS)
        if fit - price * (trial > 0).sum() < score:
            break
        best, score = trial, fit - price * (trial > 0).sum()
    return float(best[:-1].sum())


def by_language(rows, model):
    shares = [known_share(r[1], model) for r in rows]
    assert all(s is None or abs(s - 0.5) > 1e-3 for s in shares), "no text of the fixture is on the edge"
    return [r for r, s in zip(rows, shares) if s is not None and s >= 0.5]


# ---- toxicity: the sum over distinct words of the weights of their n-grams


def logit(text, model):
    z = model.bias
    for word in set(words_of(text)):
        raw = b" " + word + b" "
        for n in toxicity.SIZES:
            for i in range(len(raw) - n + 1):
                h = sum((b + 1) * pow(tx._BASE, j, 1 << 64) for j, b in enumerate(raw[i : i + n])) + n & (2**64 - 1)
                z += float(model.weight[tx.mix_one(h) >> (64 - toxicity.BITS)])
    return z


# ---- near-duplicates: all pairs of 128-bit fingerprints


def fingerprint(text):
    hashes = set()
    for word in words_of(text):
        hashes.add(tx.mix_one(sum((b + 1) * pow(tx._BASE, j, 1 << 64) for j, b in enumerate(word)) & (2**64 - 1)) >> 16)
    if not hashes:
        return None
    out = 0
    for half in (0, 1):
        mixed = [tx.mix_one(h ^ (int(simhash._SECOND) if half else 0)) for h in hashes]
        out |= sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in mixed) > len(mixed)) << (64 * half)
    return out


BLOCKS = [((1 << w) - 1) << (64 * half + s) for half in (0, 1) for s, w in simhash.BLOCKS]


def one_of_each_group(rows):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = lambda f: (signed(f & (2**64 - 1)), signed(f >> 64))
    prints = {}
    for r in rows:
        f = fingerprint(r[1])
        if r[0] is not None and f is not None:
            prints[r[0]] = min(prints.get(r[0], f), f, key=order)
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            z = prints[i] ^ prints[j]
            if z.bit_count() <= simhash.WHOLE and any((z & b).bit_count() <= 2 for b in BLOCKS):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    text_hash = lambda r: signed(xxhash.xxh64((r[1] or "").encode(), seed=42).intdigest()) if r[1] is not None else 42
    kept = {}
    for r in rows:
        if r[0] is not None and find(r[0]) == r[0] and (r[0] not in kept or text_hash(r) < text_hash(kept[r[0]])):
            kept[r[0]] = r
    return [*kept.values(), *[r for r in rows if r[0] is None]]


# ---- mixing: clamp, redistribute, repeat


def mixed(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(r[1] or "")
    live, epochs, rest = {s: n**mixing.POWER for s, n in sizes.items() if n}, {}, float(sum(sizes.values()))
    while live:
        total = sum(live.values())
        over = [s for s, w in live.items() if rest * w / total > mixing.MAX_EPOCHS * sizes[s] * (1 + 1e-12)]
        for s in over or list(live):
            epochs[s] = mixing.MAX_EPOCHS if over else rest * live[s] / total / sizes[s]
        rest -= sum(epochs[s] * sizes[s] for s in over)
        live = {s: w for s, w in live.items() if over and s not in over}
    out = []
    for r in rows:
        e = round(epochs.get(r[3], 0.0), 9)
        draw = int(hashlib.md5(f"{mixing.SEED}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:12], 16) / 2**48
        out += [r] * (int(e) + (draw < e - int(e)))
    return out


# ---- tokens: Viterbi over the whole text, one character after the other


def best_score(text, v, scores, longest):
    text = "" if not text else " " + text.replace("▁", " ")
    best = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + longest) + 1):
            s = scores.get(text[i:j])
            if s is None and j == i + 1:
                s = v.unknown_score
            if s is not None and best[i] + s > best[j]:
                best[j] = best[i] + s
    return best[-1]


def counted(rows):
    return collections.Counter(map(tuple, rows))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels = fixture()
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels + [(None, 1), (5, None), (99999, 0)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_every_stage_and_run_match_plain_python(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = list(map(tuple, docs.collect()))
    plain = {
        "language_id": lambda rows, docs: by_language(rows, langid.train(docs)),
        "toxicity": lambda rows, docs: [r for m in [toxicity.train(docs, labels)] for r in rows if logit(r[1], m) < m.threshold],
        "simhash_near_dedup": lambda rows, docs: one_of_each_group(rows),
        "source_mixing": lambda rows, docs: mixed(rows),
    }
    assert [n for n, _ in corpus_pipeline.STAGES] == [*plain, "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = plain[name](rows, docs)
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == COLUMNS
        assert counted(docs.collect()) == counted(want), name
        assert name == "source_mixing" or 0 < len(want) < len(rows), f"{name} decides something here"
        rows = want
    assert not {400, 401, 402, 403} & {r[0] for r in rows}
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "ids", "n_ids", "round_trip", "lang", "source"]
    v = pieces.Vocabulary.load()
    scores = {n.replace("▁", " "): s for n, s, k in zip(v.names, v.scores, v.kinds) if k == pieces.NORMAL}
    longest = max(map(len, scores))
    score = lambda ids: sum(v.unknown_score if v.kinds[i] == pieces.BYTE else v.scores[i] for i in ids)
    # byte pieces of a character come together: the unknown score counts once for each
    spelled = lambda ids: score([i for k, i in enumerate(ids) if v.kinds[i] != pieces.BYTE or int(v.names[i][3:5], 16) & 0xC0 != 0x80])
    got = found.collect()
    texts = [t.as_py() for r in got for t in v.decode(np.array(r.ids, np.int64), np.array([0, len(r.ids)]))]
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    assert counted((r.doc_id, t, r.lang, r.source) for r, t in zip(got, texts)) == counted((r[0], r[1].replace("▁", " "), r[2], r[3]) for r in rows)
    best = {t: best_score(t, v, scores, longest) for t in set(texts)}
    assert all(math.isclose(spelled(r.ids), best[t], rel_tol=1e-6, abs_tol=1e-3) for r, t in zip(got, texts))


def test_empty_tables(spark, tmp_path):
    rows, labels = fixture()
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame(rows, DDL)
    tox = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path))
    assert tox.columns == COLUMNS and tox.count() == len(rows), "without labels nothing is toxic"

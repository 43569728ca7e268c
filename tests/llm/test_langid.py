import numpy as np
import pyarrow as pa

from graphloom.llm import langid
from graphloom.llm import text as tx

EN = ["the quick brown fox jumps over the lazy dog and runs through the forest", "she said that they would come home before the rain began to fall again", "there is nothing better than a warm evening with good friends and music"]
DE = ["der schnelle braune fuchs springt über den faulen hund und läuft durch den wald", "sie sagte dass sie nach hause kommen würden bevor der regen wieder beginnt", "es gibt nichts besseres als einen warmen abend mit guten freunden und musik"]
FR = ["le rapide renard brun saute par dessus le chien paresseux et court dans la forêt", "elle a dit qu'ils rentreraient à la maison avant que la pluie ne recommence", "il n'y a rien de mieux qu'une chaude soirée avec de bons amis et de la musique"]


def labelled(spark, extra=()):
    rows = [(i * 3 + j, t + f" {k}" * (i % 3), lang) for i in range(30) for j, (lang, k) in enumerate((("en", "word"), ("de", "wort"), ("fr", "mot"))) for t in [{"en": EN, "de": DE, "fr": FR}[lang][i % 3]]]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")


def test_em_matches_brute_force():
    rng = np.random.default_rng(1)
    first = np.array([0, 5, 5, 17])
    chance = rng.random((17, 3)).astype(np.float32)
    shares, fit = langid._em(chance, np.repeat([0, 1, 2], [5, 0, 12]), first, np.full((3, 3), 1 / 3), 9)
    for d, (a, b) in enumerate(((0, 5), (5, 17))):
        d = d * 2
        pi = np.full(3, 1 / 3)
        for _ in range(9):
            r = chance[a:b] * pi
            pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        assert np.allclose(shares[d], pi, atol=1e-4)
        assert np.isclose(fit[d], np.log((chance[a:b] * pi).sum(axis=1)).sum(), atol=1e-3)


def test_word_likelihoods_match_brute_force(spark):
    model = langid.train(labelled(spark))
    assert model.names == ["de", "en", "fr"]
    words = tx.Words(pa.array(["über den wald 42"]))
    like = model.word_likelihoods(words, np.arange(4))
    for i, w in enumerate(("über", "den", "wald", "42")):
        raw = [32, 32] + [48 if 48 <= b <= 57 else b for b in w.encode()] + [32]
        want = 0.0
        for j in range(2, len(raw)):
            two = raw[j - 2] << 8 | raw[j - 1]
            want += model.tri[0][((two << 8 | raw[j]) * 2654435761 & 0xFFFFFFFF) >> (32 - langid.TRI_BITS)] - model.bi[0][(two * 2246822519 & 0xFFFFFFFF) >> (32 - langid.BI_BITS)]
        assert np.isclose(like[i, 0], want, atol=1e-3)


def test_identifies_mixes_and_rejects(spark):
    docs = labelled(spark, [(900, " ".join(EN + FR), None), (901, "", "en"), (902, None, None), (903, "?! --", "xx"), (None, DE[0], "de"), (904, "xqzj kvwq zzxq qjxk wvkq xxzq jqkz", None), (905, " ".join(EN * 3000), "en"), (0, EN[0], "en"), (0, EN[0], "en")])
    docs = docs.withColumn("accepted", docs.doc_id)
    model = langid.train(docs)
    got = {}
    for r in langid.identify(docs, model).collect():
        got.setdefault(r.doc_id, r)
    right = [got[i * 3 + j].top == lang for i in range(30) for j, lang in enumerate(("en", "de", "fr"))]
    assert np.mean(right) > 0.97
    assert set(got[900].languages) == {"en", "fr"} and abs(sum(got[900].proportions) - 1) < 1e-3 and got[900].accepted
    assert [got[i].accepted for i in (901, 902, 903, 904, 905)] == [False, False, False, False, True]
    assert got[901].languages == [] and got[904].top == "und" and got[None].top == "de"
    kept = langid.drop_unknown(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert langid.identify(docs.limit(0), model).count() == 0
    empty = langid.train(docs.limit(0))
    assert empty.names == [] and langid.drop_unknown(docs, empty).count() == 0


def test_rare_labels_are_modelled_and_kept(spark):
    es = ["el rápido zorro marrón salta sobre el perro perezoso y corre por el bosque", "ella dijo que volverían a casa antes de que la lluvia empezara otra vez", "no hay nada mejor que una tarde cálida con buenos amigos y música"]
    docs = labelled(spark, [(900 + i, t, "es") for i, t in enumerate(es)] + [(None, "ọjọ́ dára púpọ̀ ní ilé wa", "yo"), (910, "?! --", "xx"), (911, None, "zz")])
    model = langid.train(docs)
    assert model.names == ["de", "en", "es", "fr", "yo"]
    got = {r.doc_id: (r.top, r.accepted) for r in langid.identify(docs, model).collect()}
    assert [got[i] for i in (900, 901, 902, None)] == [("es", True)] * 3 + [("yo", True)]
    assert langid.drop_unknown(docs, model).count() == docs.count() - 2


def test_more_than_64_languages(spark):
    # each language has letters of its own and one text only
    rows = [(i, " ".join(chr(0x4E00 + 40 * i + (7 * j + k) % 40) * 2 + chr(0x4E00 + 40 * i + k) for j in range(3) for k in range(20)), f"l{i:02}") for i in range(70)]
    docs = spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.names == [r[2] for r in rows]
    assert {r.doc_id: (r.top, r.accepted) for r in langid.identify(docs, model).collect()} == {i: (lang, True) for i, _, lang in rows}
    column = pa.array([r[1] for r in rows] * 300)
    whole, cut = model._mixtures(column.slice(0, 70)), model.mixtures(column)
    assert all(np.allclose(x, y[-70:], atol=1e-5) for x, y in zip(whole, cut))

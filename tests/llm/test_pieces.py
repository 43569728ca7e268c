import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from graphloom.llm import pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def library(vocabulary):
    """The public library's own unigram engine over the same pieces and log scores."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(pieces.MODEL_PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece, score in zip(model.pieces, vocabulary.scores):
        piece.score = score
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


TEXTS = ["Hello world", "  two  spaces ", "line\nfeed\n\n end", "naïve café 你好 𝕏 \x00 tab\t.", "", "a", "     ", "\n", "the the theatre", "x" * 300, "émenttreeaux ciónmente", "a▁b"]


def test_encoding_is_the_library_s(vocabulary):
    lib = library(vocabulary)
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcdeéñ th\n 好") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    ids, at = vocabulary.encode(pa.array(texts))
    same = 0
    for i, t in enumerate(texts):
        own, theirs = ids[at[i] : at[i + 1]].tolist(), lib.encode(t)
        score = lambda x: sum(vocabulary.unknown_score if vocabulary.kinds[p] == pieces.BYTE else vocabulary.scores[p] for p in x)
        assert math.isclose(score(own), score(theirs), rel_tol=1e-6, abs_tol=1e-3)
        same += own == theirs
    assert same >= 0.99 * len(texts)


def test_viterbi_matches_brute_force():
    names = ["<unk>", " ", "a", "b", "ab", " a", "ba", " ab", "bab", "aa", "  "]
    scores = [0.0, -2.0, -1.5, -1.7, -2.2, -2.0, -2.6, -3.9, -3.0, -2.9, -2.5]
    v = pieces.Vocabulary(names, scores, [2] + [1] * 10)
    own = {n: s for n, s in zip(names[1:], scores[1:])}

    def best(t):
        return 0.0 if not t else max(own[t[:k]] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in own)

    for n in range(1, 8):
        for letters in itertools.product("ab ", repeat=n):
            t = " " + "".join(letters)
            ids = v.segment(t.encode())
            assert "".join(names[i] for i in ids) == t and math.isclose(sum(own[names[i]] for i in ids), best(t))
    ids, at = v.encode(pa.array(["ab  aab", "", " b"]))
    assert math.isclose(sum(scores[i] for i in ids[: at[1]]), best(" ab  aab"))
    assert [v.names[i] for i in v.segment(b"z")] == ["<unk>"], "without byte pieces"


def test_many_at_once_is_one_by_one(vocabulary):
    rng = random.Random(8)
    chunks = ["".join(rng.choice("abethn .é好𝕏\x01") for _ in range(rng.randint(1, 40))).encode()[:48] for _ in range(400)]
    data = np.frombuffer(b"".join(chunks), np.uint8)
    length = np.array([len(c) for c in chunks])
    assert vocabulary.segment_many(data, np.cumsum(length) - length, length) == [vocabulary.segment(c) for c in chunks]


def test_double_array_finds_exactly_its_keys():
    rng = random.Random(4)
    keys = {bytes(rng.choice(b"abc\xff\x01") for _ in range(rng.randint(1, 6))): i for i in range(500)}
    trie = pieces.DoubleArray(keys)
    assert all(trie.find(k) == i for k, i in keys.items())
    assert all(trie.find(k) == keys.get(k, -1) for k in (bytes(rng.choice(b"abc\xff\x01") for _ in range(rng.randint(1, 7))) for _ in range(2000)))


def test_round_trip_and_edge_cases(spark, vocabulary):
    rows = list(enumerate(TEXTS)) + [(50, None), (None, "no id"), (0, "Hello world"), (60, "long " * 40000)]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, ids string")
    got = pieces.encode(docs)
    found = got.collect()
    assert len(found) == len(rows) and all(r.round_trip for r in found)
    texts = {r.doc_id: r.text for r in pieces.decode(got).collect()}
    assert all(texts[i] == (t or "").replace("▁", " ") for i, t in rows)
    assert pieces.encode(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, [3 + 0xC3]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert dict(map(tuple, pieces.decode(odd).collect())) == {1: "�", 2: None, 3: ""}
    assert np.array_equal(*[vocabulary.encode(pa.array(TEXTS * k))[0][:20] for k in (1, 2)])

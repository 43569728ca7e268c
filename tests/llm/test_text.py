import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import text as tx

texts = st.lists(st.text(alphabet="ab Z9.\né—😀", max_size=30), max_size=8)


def words(t):
    return re.findall(rb"[0-9a-z\x80-\xff]+", t.lower().encode())


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_match_a_regular_expression(ts):
    w = tx.Words(tx.lower(tx.clean(pa.array(ts, pa.string()))))
    got = [[w.data[a:b].tobytes() for a, b in zip(w.start[i:j], w.stop[i:j])] for i, j in zip(w.first, w.first[1:])]
    assert got == [words(t) for t in ts]


@settings(max_examples=100, deadline=None)
@given(texts, st.integers(1, 4))
def test_shingles_equal_iff_words_equal(ts, k):
    w = tx.Words(tx.lower(tx.clean(pa.array(ts, pa.string()))))
    hashes, at = w.shingles(k)
    names = {}
    for i, t in enumerate(ts):
        ws = words(t)
        runs = [tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)] if len(ws) >= k else [tuple(ws)] if ws else []
        own = hashes[at[i] : at[i + 1]].tolist()
        assert len(own) == len(runs)
        for run, h in zip(runs, own):
            assert names.setdefault(h, run) == run
    assert len(set(names.values())) == len(names)


def test_nulls_slices_and_offsets():
    column = pa.array(["drop", None, "", "x" * 50, "one two"]).slice(1)
    column = tx.clean(column)
    data, at = tx.buffers(column)
    assert at.tolist() == [0, 0, 0, 50, 57] and len(data) == 57
    assert list(tx.slices(column, 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(tx.slices(column.slice(0, 0))) == []
    assert tx.segment_sum(np.array([1, 2, 3]), np.array([0, 0, 2, 3])).tolist() == [0, 3, 3]


def test_words_and_hashes_don_t_depend_on_blocks(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abé  .\n") for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["x" * 100, "", "", " y"]
    whole = tx.Words(pa.array(texts))
    spans = tx.span_hash(tx.prefix_hash(whole.data), whole.start, whole.stop)
    assert np.array_equal(whole.hash, tx.mix(spans))
    for size in (1, 3, 16, 64):
        monkeypatch.setattr(tx, "BLOCK_BYTES", size)
        cut = tx.Words(pa.array(texts))
        assert all(np.array_equal(getattr(whole, x), getattr(cut, x)) for x in ("start", "stop", "first", "hash"))


def test_words_of_a_very_long_text_take_little_memory():
    code = "import resource, pyarrow as pa; from graphloom.llm import text as tx; b = 100 << 20; a = pa.array(['some words, ' * (b // 12)]); w = tx.Words(a); print(len(w.hash), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    words, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert words == 2 * ((100 << 20) // 12) and mb < 1400

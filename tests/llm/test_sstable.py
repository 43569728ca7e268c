import hashlib
import io
import os
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import sstable


def table(entries, block_bytes=64):
    sink = io.BytesIO()
    w = sstable.Writer(sink, block_bytes)
    for k, v in entries:
        w.add(sstable.key_bytes(k), v)
    w.close()
    return sink.getvalue()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1) | st.integers(-5, 5), st.binary(max_size=40)), max_size=60))
def test_lookup_is_a_dictionary(entries):
    entries = sorted(entries)
    reader = sstable.Reader(pa.PythonFile(io.BytesIO(table(entries)), "r"))
    want = {}
    for k, v in entries:
        want.setdefault(k, []).append(v)
    for k in [*want, 0, 7, -(2**63), 2**63 - 1]:
        assert reader.get(sstable.key_bytes(k)) == want.get(k, [])
    assert [(sstable.key_number(k), v) for k, v in reader.scan()] == entries


def test_bloom_filter_and_damage():
    rng = random.Random(1)
    keys = sorted(rng.sample(range(10**9), 2000))
    raw = table([(k, b"v") for k in keys], 4096)
    reader = sstable.Reader(pa.PythonFile(io.BytesIO(raw), "r"))
    assert all(reader.may_hold(sstable.key_bytes(k)) for k in keys)
    assert sum(reader.may_hold(sstable.key_bytes(10**9 + i)) for i in range(5000)) < 150
    with pytest.raises(ValueError):
        sstable.Reader(pa.PythonFile(io.BytesIO(raw[:-1] + b"x"), "r"))
    broken = bytearray(raw)
    broken[20] ^= 1
    with pytest.raises(ValueError):
        sstable.Reader(pa.PythonFile(io.BytesIO(bytes(broken)), "r")).get(sstable.key_bytes(keys[0]))


def test_values():
    for v, want in ((None, None), ("aé", "aé".encode()), (b"\0", b"\0"), ([], []), ([1, 65535], [1, 65535]), ([70000, 0], [70000, 0]), ("", b"")):
        assert sstable.unpack_value(sstable.pack_value(v)) == want
    with pytest.raises(ValueError):
        sstable.pack_value([-1])


def test_shards(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(-1000, 10**6), f"text {i}" * rng.randint(0, 9)) for i in range(3000)] + [(7, "a"), (7, "b"), (7, "b"), (8, None), (9, ""), (None, "lost"), (10, "z" * 500000)]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, path string").repartition(5)
    folder = str(tmp_path / "shards")
    manifest = sstable.write(docs, folder, shard_bytes=20000)
    assert sum(r.n for r in manifest.collect()) == len(rows) - 1 and manifest.count() > 3
    got = sstable.lookup(manifest, [7, 8, 9, 10, rows[0][0], -99999])
    assert got[7] == [b"a", b"b", b"b"] and got[8] == [None] and got[9] == [b""] and len(got[10][0]) == 500000 and got[-99999] == []
    assert sorted(got[rows[0][0]]) == sorted(t.encode() for i, t in rows if i == rows[0][0])
    seen = sorted((r.doc_id, r.n_bytes or 0, r.md5 or "") for r in sstable.write_and_verify(docs, str(tmp_path / "again"), shard_bytes=20000).collect())
    assert seen == sorted((i, len((t or "").encode()), hashlib.md5(t.encode()).hexdigest() if t is not None else "") for i, t in rows if i is not None)
    ids = spark.createDataFrame([(1, [5, 6]), (2, None)], "doc_id long, ids array<int>")
    kept = sstable.write(ids, str(tmp_path / "ids"), value_col="ids")
    assert sstable.lookup(kept, [1, 2]) == {1: [[5, 6]], 2: [None]}
    assert sstable.write(docs.limit(0), str(tmp_path / "none")).count() == 0
    assert not [f for f in os.listdir(spark.conf.get("spark.checkpoint.dir")) if "packed" in f], "no scratch table is left behind"
    one = spark.createDataFrame([("5", "a"), ("no number", "b"), *[("6", f"{i} " * 2000) for i in range(40)]], "k string, v string")
    hot = sstable.write(one, str(tmp_path / "hot"), "k", "v", 20000)
    assert hot.count() > 3 and sstable.lookup(hot, [5, 6]) == {5: [b"a"], 6: sorted(f"{i} ".encode() * 2000 for i in range(40))}, "a key may fill several shards"


def test_token_shards(spark, tmp_path):
    rows = [(1, "Hello  world, naïve 好"), (1, "again"), (2, None), (3, ""), (None, "lost"), (4, "long text " * 30000), (5, "a▁b"), (-6, "\n")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    found = sstable.token_shards(docs, str(tmp_path / "tokens"))
    want = sorted((i, (t or "").replace("▁", " ").encode()) for i, t in rows if i is not None)
    assert sorted(map(tuple, found.collect())) == sorted((i, len(t), hashlib.md5(t).hexdigest()) for i, t in want)
    files = sorted(os.listdir(tmp_path / "tokens"))
    assert found.count() == len(want) and sorted(os.listdir(tmp_path / "tokens")) == files, "a second action reads and doesn't write again"
    assert sstable.token_shards(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_paths_lie_where_spark_puts_them():
    assert sstable._target("/a/b")[1] == "/a/b" and sstable._target("file:/a/b")[1] == sstable._target("file:///a/b")[1] == "/a/b"
    with pytest.raises(pa.ArrowInvalid):
        sstable._target("/a/b", "nosuch://host")

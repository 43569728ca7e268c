"""Bottom-k sketches of word shingles: mergeable document fingerprints.

A sketch holds the k least distinct shingle hashes of a text (52 bits each), rising.  Sketches of parts
merge into the sketch of the whole: the k least of their union.  Two sketches estimate the resemblance
(Jaccard) and the containment of the sets behind them, and one estimates its number of shingles.

A benchmark is small: the shingles of its items are held in full, and so are those of each document while
it is read, so that `fingerprints` counts what they share instead of estimating it from sketches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from graphloom.llm import text as tx
from graphloom.llm.common import per_slice, texts

K, SHINGLE = 64, 5
SPACE = 1 << 52


def _distinct(column: pa.Array, shingle: int):
    """(first row, hashes, ranges) of 4096 rows at a time: the distinct shingle hashes of each row, rising."""
    words = tx.Words(tx.lower(tx.clean(column)))
    hashes, at = words.shingles(shingle)
    rows = len(column)
    doc = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(at))
    # 12 bits are left for the row, so 4096 rows at a time
    for a in range(0, rows, 4096):
        b = min(rows, a + 4096)
        lo, hi = at[a], at[b]
        own = np.unique(((doc[lo:hi] - np.uint64(a)) << np.uint64(52)) | (hashes[lo:hi] >> np.uint64(12)))
        first = np.append(np.searchsorted(own, np.arange(b - a, dtype=np.uint64) << np.uint64(52)), len(own))
        yield a, (own & np.uint64(SPACE - 1)).astype(np.int64), first


def _least(parts: list[tuple[int, np.ndarray, np.ndarray]], rows: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kept, counts = [], np.zeros(rows, np.int64)
    for a, own, first in parts:
        n = np.diff(first)
        counts[a : a + len(n)] = n
        kept.append(own[np.arange(len(own)) - np.repeat(first[:-1], n) < k])
    out = np.zeros(rows + 1, np.int64)
    np.cumsum(np.minimum(counts, k), out=out[1:])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64), out, counts


def sketches(column: pa.Array, k: int = K, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all sketches one after the other, their ranges, and the true number of distinct shingles."""
    return _least(list(_distinct(column, shingle)), len(column), k)


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of what the parts sketch."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *parts]))[:k]


def estimate_distinct(sketch: np.ndarray, k: int = K) -> float:
    """Number of distinct shingles; exact while the sketch isn't full."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((float(sketch[k - 1]) + 1) / SPACE)


def estimate_resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard of the two sets; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    union = merge([a, b], k)
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def estimate_containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's set that is in b's: of a's hashes that b's sketch could hold, how many it does."""
    if not len(a) or not len(b):
        return 0.0
    reach = a if len(b) < k else a[a <= b[-1]]
    if not len(reach):
        # b reaches lower than all of a: by way of the resemblance
        j, na, nb = estimate_resemblance(a, b, k), estimate_distinct(a, k), estimate_distinct(b, k)
        return float(min(1.0, j * (na + nb) / (1 + j) / max(na, 1)))
    return len(np.intersect1d(reach, b, True)) / len(reach)


def _sketch_columns(values: np.ndarray, at: np.ndarray, k: int) -> dict:
    full = np.diff(at) >= k
    last = values[np.maximum(at[1:] - 1, 0)] if len(values) else np.zeros(len(full), np.int64)
    n = np.where(full, (k - 1) / ((last + 1.0) / SPACE), np.diff(at))
    return {"sketch": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values)), "n_shingles": np.round(n, 3)}


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, shingle: int = SHINGLE, *more: str) -> DataFrame:
    """(doc_id, sketch, n_shingles) of every row; an empty sketch for a null, empty or wordless text."""

    def make(batch: pa.RecordBatch) -> dict:
        values, at, _ = sketches(batch.column(1), k, shingle)
        return {"doc_id": batch.column(0), **_sketch_columns(values, at, k), **{c: batch.column(2 + i) for i, c in enumerate(more)}}

    return per_slice(texts(docs, id_col, text_col, *more), make, "doc_id long, sketch array<long>, n_shingles double" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more))


def merge_by(sketched: DataFrame, key: str, k: int = K) -> DataFrame:
    """(key, sketch, n_shingles): one merged sketch for each key; partial merges come before the shuffle."""
    kind = sketched.schema[key].dataType.simpleString()

    def partial(batches):
        held: dict = {}
        for batch in batches:
            for name, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(name, []).append(np.asarray(values.values) if values.is_valid else np.zeros(0, np.int64))
                if len(held[name]) > 256:
                    held[name] = [merge(held[name], k)]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), batch_type), pa.array([merge(x, k) for x in held.values()], pa.list_(pa.int64()))], ["key", "sketch"])

    batch_type = to_arrow_type(sketched.schema[key].dataType)
    parts = sketched.select(F.col(key).alias("key"), "sketch").mapInArrow(partial, f"key {kind}, sketch array<long>")
    # at most k hashes a key and task: the union is small and exact
    least = parts.select("key", F.explode("sketch").alias("h")).groupBy("key").agg(F.slice(F.array_sort(F.collect_set("h")), 1, k).alias("sketch"))
    keys = parts.select("key").distinct()
    joined = keys.join(least, keys.key.eqNullSafe(least.key), "left").select(keys.key.alias(key), F.coalesce("sketch", F.array().cast("array<long>")).alias("sketch"))
    last = F.element_at("sketch", k).cast("double")
    return joined.withColumn("n_shingles", F.when(F.size("sketch") < k, F.size("sketch").cast("double")).otherwise(F.round((k - 1) / ((last + 1) / F.lit(float(SPACE))), 3)))


def compare_with(sketched: DataFrame, target: np.ndarray, k: int = K, target_k: int | None = None) -> DataFrame:
    """Adds the estimated resemblance to, and containment in, one target sketch (its own size may be larger)."""
    schema = sketched.schema
    at = sketched.columns.index("sketch")
    held = sketched.sparkSession.sparkContext.broadcast(np.asarray(target, np.int64))
    target_k = target_k or k

    def run(batches):
        for batch in batches:
            same, inside = [], []
            for values in batch.column(at):
                own = np.asarray(values.values, np.int64) if values.is_valid else np.zeros(0, np.int64)
                same.append(round(estimate_resemblance(own, held.value[:k], k), 6))
                inside.append(round(estimate_containment(own, held.value, target_k), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.float64()), pa.array(inside, pa.float64())], [*batch.schema.names, "resemblance", "containment"])

    return sketched.mapInArrow(run, StructType([*schema.fields, StructField("resemblance", DoubleType()), StructField("containment", DoubleType())]))


def reference_shingles(reference: DataFrame, reference_id: str = "item_id", shingle: int = SHINGLE) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of a benchmark, none cut off: (ids, shingles of each item, distinct hashes rising, ranges, items that have each hash).

    Rows that repeat an id are one item; an item without words has no shingles.
    """

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            column = tx.clean(batch.column(1))
            for a, b in tx.slices(column):
                for c, own, first in _distinct(column.slice(a, b - a), shingle):
                    of = np.repeat(np.arange(len(first) - 1), np.diff(first)) + a + c
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(own, pa.int64())], ["item_id", "h"])

    found = texts(reference, reference_id, "text").mapInArrow(run, "item_id long, h long").distinct().toArrow().sort_by([("h", "ascending"), ("item_id", "ascending")])
    ids = sorted(set(found.column("item_id").to_pylist()), key=lambda x: (x is None, x or 0))
    place = {x: i for i, x in enumerate(ids)}
    item = np.array([place[x] for x in found.column("item_id").to_pylist()], np.int64)
    hashes, first = np.unique(found.column("h").to_numpy(), return_index=True)
    return ids, np.bincount(item, minlength=len(ids)), hashes, np.append(first, len(item)), item


def fingerprints(docs: DataFrame, reference: DataFrame, reference_id: str = "item_id", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, sketch, n_shingles, resemblance, containment, matches) of all documents, against the reference texts.

    The reference is a fixed list (a benchmark) whose shingles are broadcast in full, 16 bytes each.
    `resemblance` and `containment` are those of the document and all items together.  `matches` has an entry for
    each item that shares a shingle with the document, by item_id: (item_id, shared, resemblance, containment,
    item_containment), the containments being the shares of the document's and of the item's distinct shingles.
    All these are counts over every shingle, also of long documents; `sketch` and `n_shingles` are of k hashes.
    Rows without a doc_id keep a null id; repeated rows give repeated results; an empty reference gives zeros.
    """
    held = docs.sparkSession.sparkContext.broadcast(reference_shingles(reference, reference_id, shingle))
    names = ["item_id", "shared", "resemblance", "containment", "item_containment"]

    def make(batch: pa.RecordBatch) -> dict:
        ids, sizes, known, first, item = held.value
        rows = batch.num_rows
        parts = list(_distinct(batch.column(1), shingle))
        values, at, n = _least(parts, rows, k)
        hits, pairs = np.zeros(rows, np.int64), []
        for a, own, own_first in parts:
            if not len(known):
                continue
            near = np.minimum(np.searchsorted(known, own), len(known) - 1)
            there = np.flatnonzero(known[near] == own)
            row, near = a + np.searchsorted(own_first, there, "right") - 1, near[there]
            hits += np.bincount(row, minlength=rows)
            each = first[near + 1] - first[near]
            pairs.append(np.repeat(row, each) * len(ids) + item[tx.take_ranges(first[near], each)])
        pair, shared = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]), return_counts=True)
        row, which = pair // max(len(ids), 1), pair % max(len(ids), 1)
        columns = [pa.array(ids, pa.int64()).take(pa.array(which)), pa.array(shared), *(pa.array(np.round(shared / x, 6)) for x in (n[row] + sizes[which] - shared, n[row], sizes[which]))]
        ranges = np.searchsorted(row, np.arange(rows + 1))
        matches = pa.ListArray.from_arrays(pa.array(ranges, pa.int32()), pa.StructArray.from_arrays(columns, names))
        return {"doc_id": batch.column(0), **_sketch_columns(values, at, k), "resemblance": np.round(hits / np.maximum(n + len(known) - hits, 1), 6), "containment": np.round(hits / np.maximum(n, 1), 6), "matches": matches}

    return per_slice(texts(docs), make, "doc_id long, sketch array<long>, n_shingles double, resemblance double, containment double, matches array<struct<item_id: long, shared: long, resemblance: double, containment: double, item_containment: double>>")

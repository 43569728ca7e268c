"""SimHash near-duplicates by pigeonhole blocks.

Features are the distinct words of a text, each voting once on 128 bits.  Two texts are near if their
fingerprints differ in at most `WHOLE` = 22 of the 128 bits, and `every_pair` finds all such pairs: the bits
are cut into blocks with a tolerance each, and as the tolerances and one more for every block add up to 23,
22 differing bits keep within the tolerance of one block at least.  Fingerprints are dealt to chunks; a task
holds two of them sorted by a block and looks up each value of the one with all its variations within the
tolerance in the other, in numpy.  Equal fingerprints are collapsed beforehand, so the number of exact
copies never enters the search; groups are the connected components of the pairs.

`pairs` and `near_pairs` meet in an equi-join instead, of three blocks of 22, 21 and 21 bits in a half and
their one-bit variations.  `pairs` has all within `DISTANCE` = 8 bits of the first half; `near_pairs` has
only those within 2 bits of one of six blocks, so it leaves out pairs of 18 to 22 bits that are spread over
all six.  No query takes either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import text as tx
from graphloom.llm.common import cut, fresh, integer, per_slice, texts

DISTANCE, WHOLE = 8, 22
_SECOND = np.uint64(0xD1B54A32D192ED03)
#: (shift, width) of the blocks of a half
BLOCKS = ((42, 22), (21, 21), (0, 21))
#: Fingerprints of a chunk, and candidates that are compared at a time.
CHUNK, STEP = 1_000_000, 1 << 18

_LANES = np.zeros(256, np.uint64)
for _b in range(256):
    _LANES[_b] = sum(1 << (8 * i) for i in range(8) if _b >> i & 1)


def _votes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many hashes of each range have each of the 64 bits; 255 of them fit a lane of eight bits."""
    counts = np.zeros((len(at) - 1, 64), np.int64)
    n = np.diff(at)
    pieces = np.maximum(-(-n // 255), 0)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(pieces, out=first[1:])
    owner = np.repeat(np.arange(len(n)), pieces)
    cuts = at[:-1][owner] + 255 * (np.arange(first[-1]) - first[:-1][owner])
    if not len(cuts):
        return counts
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, j]], cuts).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts[:, 8 * j : 8 * j + 8] = tx.segment_sum(lanes, first)
    return counts


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both halves of each text's fingerprint, and whether it has one (a text without words has none)."""
    rows = len(column)
    if rows > 1 << 15:
        parts = [fingerprints(column.slice(i, 1 << 15)) for i in range(0, rows, 1 << 15)]
        return tuple(np.concatenate(x) for x in zip(*parts))
    words = tx.Words(tx.lower(tx.clean(column)))
    # distinct words of each text: the row in the upper 16 bits, 48 bits of the hash below
    both = np.unique((words.text_of().astype(np.uint64) << np.uint64(48)) | (words.hash >> np.uint64(16)))
    at = np.append(np.searchsorted(both, np.arange(rows, dtype=np.uint64) << np.uint64(48)), len(both))
    n, names = np.diff(at), both & np.uint64((1 << 48) - 1)

    def half(hashes: np.ndarray) -> np.ndarray:
        bit = (2 * _votes(tx.mix(hashes), at) > n[:, None]).astype(np.uint8)
        return np.packbits(bit, axis=1, bitorder="little").view("<u8").reshape(-1) if rows else np.zeros(0, np.uint64)

    return half(names), half(names ^ _SECOND), n > 0


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fp2) of every row that has an id; both are null where the text has no words or is null."""

    def make(batch: pa.RecordBatch) -> dict:
        fp, fp2, there = fingerprints(batch.column(1))
        return {"doc_id": batch.column(0), **{c: pa.array(x.view(np.int64), pa.int64(), mask=~there) for c, x in (("fp", fp), ("fp2", fp2))}}

    return per_slice(texts(docs, id_col, text_col).where("doc_id is not null"), make, "doc_id long, fp long, fp2 long", rows=4096)


def _block(half: F.Column | str, shift: int, width: int) -> F.Column:
    return F.shiftrightunsigned(half, shift).bitwiseAND(F.lit((1 << width) - 1))


def _places(halves: tuple[str, ...]) -> list[tuple[str, int, int]]:
    """(half, shift, width) of the blocks of the given halves, in the order of their numbers."""
    return [(half, shift, width) for half in halves for shift, width in BLOCKS]


def _blocked(nodes: DataFrame, halves: tuple[str, ...]) -> DataFrame:
    """One row for each block and variation: key, its block's number above 22 bits, and flip (-1: unchanged, else the bit that is turned)."""
    made = []
    for number, (half, shift, width) in enumerate(_places(halves)):
        value = _block(half, shift, width)
        own = F.struct((value + (number << 22)).alias("key"), F.lit(-1).cast("int").alias("flip"))
        made.append(F.array(own, *[F.struct((value.bitwiseXOR(F.lit(1 << i)) + (number << 22)).alias("key"), F.lit(i).cast("int").alias("flip")) for i in range(width)]))
    return nodes.select("rep", "fp", "fp2", F.explode(F.concat(*made)).alias("b")).select("rep", "fp", "fp2", "b.key", "b.flip")


def _first() -> F.Column:
    return F.col("a.fp").bitwiseXOR(F.col("b.fp"))


def _rest() -> F.Column:
    return F.col("a.fp2").bitwiseXOR(F.col("b.fp2"))


def _meet(nodes: DataFrame, halves: tuple[str, ...], near: F.Column) -> DataFrame:
    """(a, b, distance), a < b, each once, of nodes at most 2 bits apart in a block of the halves that fulfil `near`."""
    rows = _blocked(nodes, halves)
    a, b = rows.alias("a"), rows.alias("b")
    number = F.shiftright("a.key", 22)
    differ = {"fp": _first(), "fp2": _rest()}
    # a pair that agrees in several blocks counts in the first of them, and there under one key
    places = _places(halves)
    once = F.lit(True)
    for i, (half, shift, width) in reversed(list(enumerate(places[:-1]))):
        once = (number == i) | ((F.bit_count(_block(differ[half], shift, width)) > 2) & once)
    one_key = (F.col("a.flip") < F.col("b.flip")) | ((F.col("a.flip") == -1) & (F.col("b.flip") == -1))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.rep") < F.col("b.rep")) & one_key & near & once)
    return met.select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), (F.bit_count(_first()) + F.bit_count(_rest())).cast("int").alias("distance"))


def pairs(nodes: DataFrame, distance: int = DISTANCE, whole: int = WHOLE) -> DataFrame:
    """All (a, b, distance), a < b, of nodes (rep, fp, fp2) within `distance` <= 8 bits of fp and `whole` of both, each once."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"three blocks with two bits each find distances up to {DISTANCE}")
    return _meet(nodes, ("fp",), (F.bit_count(_first()) <= distance) & (F.bit_count(_first()) + F.bit_count(_rest()) <= whole))


def near_pairs(nodes: DataFrame, whole: int = WHOLE) -> DataFrame:
    """All (a, b, distance), a < b, of nodes (rep, fp, fp2) within `whole` of 128 bits and 2 bits of one of the six blocks, each once."""
    return _meet(nodes, ("fp", "fp2"), F.bit_count(_first()) + F.bit_count(_rest()) <= whole)


def _layout(n: int, whole: int) -> list[tuple[int, int, int, int]]:
    """(half, shift, width, tolerance) of the blocks that find all pairs within `whole` bits; the cheapest for two chunks of n."""
    best = n * n / 2, [(0, 0, 0, 0)]  # a block without bits: all pairs
    for a_half in (3, 4, 5, 6, 8):
        most, more = divmod(whole + 1, 2 * a_half)
        blocks, cost = [], 0.0
        for number in range(2 * a_half):
            k = number // 2
            width = 64 // a_half + (k < 64 % a_half)
            shift = k * (64 // a_half) + min(k, 64 % a_half)
            if (tolerance := most - (number >= more)) >= 0:
                blocks.append((number % 2, shift, width, tolerance))
                variations = sum(math.comb(width, i) for i in range(tolerance + 1))
                # calls, look-ups and candidates; texts share words, so about twice as many as of random bits
                cost += variations * (10_000 + n / 2 + n * n / 2**width)
        best = min(best, (cost, blocks), key=lambda x: x[0])
    return best[1]


def _values(half: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (half >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def _search(a: np.ndarray, b: np.ndarray | None, whole: int, blocks: list[tuple[int, int, int, int]], number: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the pairs a[:, i], b[:, j] within `whole` bits whose first block within its tolerance is `number`.

    a and b hold both halves; without b these are the pairs inside a, each once.
    """
    half, shift, width, tolerance = blocks[number]

    def by_value(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value = _values(x[half], shift, width).astype(np.int32)
        order = np.argsort(value, kind="stable")
        return order, value[order], x[:, order]

    order_a, value, a = by_value(a)
    order_b, other, b = (order_a, value, a) if (same := b is None) else by_value(b)
    first = np.zeros((1 << width) + 1, np.int32)
    np.cumsum(np.bincount(other, minlength=1 << width), out=first[1:])
    for turned in (t for k in range(tolerance + 1) for t in combinations(range(width), k)):
        variation = sum(1 << t for t in turned)
        if same and turned:
            # of two values that differ in these bits the one without the highest looks up the other
            rows = np.flatnonzero((value >> turned[-1]) & 1 == 0)
            target = value[rows] ^ variation
        else:
            rows = np.arange(len(value))
            target = value ^ variation
        low = rows + 1 if same and not turned else first[target]
        count = first[target + 1] - low
        ends = np.cumsum(count, dtype=np.int64)
        at = 0
        while at < len(rows):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + STEP, "right")))
            part, n, own = slice(at, to), int(ends[to - 1]) - before, rows[at:to]
            at = to
            if not n:
                continue
            j = np.arange(before, before + n) + np.repeat(low[part] - (ends[part] - count[part]), count[part])
            apart = np.bitwise_count(np.repeat(a[half, own], count[part]) ^ b[half, j])
            hit = np.flatnonzero(apart <= whole)
            i, j = own[np.searchsorted(ends[part], before + hit, "right")], j[hit]
            distance = apart[hit].astype(np.int32) + np.bitwise_count(a[1 - half, i] ^ b[1 - half, j])
            good = distance <= whole
            i, j, distance = i[good], j[good], distance[good]
            for h, s, w, t in blocks[:number]:
                good = np.bitwise_count(_values(a[h, i] ^ b[h, j], s, w)) > t
                i, j, distance = i[good], j[good], distance[good]
            if len(i):
                yield order_a[i], order_b[j], distance


def every_pair(nodes: DataFrame, whole: int = WHOLE, chunk: int = CHUNK) -> DataFrame:
    """All (a, b, distance), a < b, of nodes (rep, fp, fp2) within `whole` of 128 bits, each once.

    A task compares two chunks, or with few chunks some of their blocks, so a node is sent to as many tasks
    as there are chunks, or to eight or so: 24 bytes each time.
    """
    total = nodes.count()
    chunks = max(1, -(-total // chunk))
    blocks = _layout(-(-total // chunks), whole)
    shares = max(1, min(len(blocks), 8 // chunks))
    own, other = F.pmod(F.xxhash64("rep"), F.lit(chunks)), F.expr(f"s div {shares}")
    low, high = F.least(own, other), F.greatest(own, other)
    task = ((high * (high + 1) / 2).cast("long") + low) * shares + F.col("s") % shares
    sent = nodes.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(chunks * shares - 1))))
    sent = sent.select(task.cast("int").alias("task"), ((own == high) & (low < high)).alias("second"), (low == high).alias("same"), "rep", "fp", "fp2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition is a task
        got = [x for x in batches if x.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        del got
        share, same = rows.column("task")[0].as_py() % shares, rows.column("same")[0].as_py()
        second, rep = rows.column("second").to_numpy(), rows.column("rep").to_numpy()
        prints = np.stack([rows.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2")])
        del rows
        sides = (prints, None) if same else (prints[:, ~second], prints[:, second])
        names = (rep, rep) if same else (rep[~second], rep[second])
        for number in range(share, len(blocks), shares):
            for i, j, distance in _search(*sides, whole, blocks, number):
                x, y = names[0][i], names[1][j]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(distance)], ["a", "b", "distance"])

    return sent.repartitionById(chunks * (chunks + 1) // 2 * shares, "task").mapInArrow(run, "a long, b long, distance int")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of the component, by alternating large-star and small-star steps.

    Each round brings every node nearer to its label, so a chain of n nodes takes about log n rounds and the loop ends.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = links.union(links.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v"))
        links = cut(small.where("u <> v").distinct())
        now = tuple(links.agg(F.count("*"), F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.lit(0))).first())
        if now == before:
            return links.toDF("node", "label")
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: int = WHOLE) -> DataFrame:
    """(doc_id, group_id, links, keep, fp, fp2) of every document; group_id is the least doc_id of its group.

    `links` counts the other fingerprints near to the document's own; documents with one fingerprint are in
    one group without a link.  Texts that are null, empty or without words have no fingerprint and stand
    alone.  Rows that repeat a doc_id are one document: the row with the least fingerprint speaks for it.
    Rows without an integer doc_id are left out.  An empty table gives an empty table; other columns are ignored.
    """
    prints = cut(fingerprint_table(docs, id_col, text_col).groupBy("doc_id").agg(F.min(F.struct("fp", "fp2")).alias("f")).select("doc_id", "f.fp", "f.fp2"))
    nodes = cut(prints.where("fp is not null").groupBy("fp", "fp2").agg(F.min("doc_id").alias("rep")))
    near = cut(every_pair(nodes, whole).select("a", "b"))
    degree = near.select(F.explode(F.array("a", "b")).alias("end")).groupBy("end").agg(F.count("*").alias("links"))
    named = nodes.join(components(near), F.col("rep") == F.col("node"), "left").join(degree, F.col("rep") == F.col("end"), "left")
    named = named.select("fp", "fp2", F.coalesce("label", "rep").alias("group_id"), "links")
    out = prints.join(named, ["fp", "fp2"], "left").withColumn("group_id", F.coalesce("group_id", "doc_id"))
    return out.select("doc_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"), (F.col("doc_id") == F.col("group_id")).alias("keep"), "fp", "fp2")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: int = WHOLE) -> DataFrame:
    """The table with one row for each group, the one with the least doc_id; columns unchanged.

    Of rows that repeat a doc_id the one with the least text hash stays; rows without an integer doc_id stay all.
    """
    number, key = fresh(docs, "row_of_id"), fresh(docs, "key_of_id")
    gone = fresh(docs, "gone_id")
    groups = near_duplicates(docs, id_col, text_col, whole).where("not keep").select(F.col("doc_id").alias(gone))
    keyed = docs.withColumn(key, integer(docs[id_col]))
    # a rank limit, so a doc_id that repeats is thinned out before the shuffle; the anti-join keeps that shuffle's partitions
    first = Window.partitionBy(key).orderBy(F.xxhash64(text_col))
    one = keyed.where(F.col(key).isNotNull()).withColumn(number, F.row_number().over(first)).where(F.col(number) == 1).drop(number)
    left = one.join(groups, F.col(key) == F.col(gone), "left_anti")
    return left.unionByName(keyed.where(F.col(key).isNull())).drop(key)

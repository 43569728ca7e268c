"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

A space is written as the marker U+2581 and one is put before the text; the best segmentation by the
sum of log scores is found by Viterbi; a character that no piece covers is spelled in byte pieces.
No piece crosses a border between two bytes that stand side by side in no piece, so the best
segmentation of a text is that of the chunks between such borders, one after the other: each distinct
chunk is segmented once and remembered by the worker.  A model trained as BPE holds merge ranks instead of
log scores; they become log probabilities by Zipf's law, score = -ln(rank + 1) - ln(sum of 1 / (rank + 1)).
"""

from __future__ import annotations

import array
import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import text as tx
from graphloom.llm.common import integer, per_slice, texts

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Where the vocabulary lies; a parameter of everything that reads it.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks a worker remembers before it forgets them all; results don't depend on it.
REMEMBERED = 1_000_000
#: Chunks that are segmented together; their tables are the largest that the encoder holds.
TOGETHER = 8192


def _fields(blob: bytes):
    """(number, value) of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = blob[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            yield key >> 3, blob[i : i + 8]
            i += 8
        elif kind == 2:
            n = varint()
            yield key >> 3, blob[i : i + n]
            i += n
        elif kind == 5:
            yield key >> 3, blob[i : i + 4]
            i += 4
        else:
            raise ValueError(f"wire type {kind}")


def read_model(path: str) -> tuple[list[str], list[float], list[int], bool]:
    """Pieces, scores, types and whether the scores are merge ranks."""
    names, scores, kinds, ranks = [], [], [], False
    with open(path, "rb") as f:
        blob = f.read()
    for number, value in _fields(blob):
        if number == 1:
            piece = dict(_fields(value))
            names.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            ranks = dict(_fields(value)).get(3, 1) == 2
    return names, scores, kinds, ranks


class DoubleArray:
    """Trie in two integer arrays: child of node s by byte c is base[s] + c if check there is s."""

    def __init__(self, keys: dict[bytes, int]):
        tree: list[dict[int, int]] = [{}]
        value = [-1]
        for key, number in keys.items():
            node = 0
            for byte in key:
                node = tree[node].setdefault(byte, len(tree))
                if node == len(tree):
                    tree.append({})
                    value.append(-1)
            value[node] = number
        size = 1 << 12
        base, check, values = [0] * size, [-1] * size, [-1] * size
        check[0] = -2
        place = {0: 0}
        # below 257 some bytes would have a negative offset
        first_free, hint, todo = 257, 257, [0]
        for node in todo:
            children = sorted(tree[node])
            at = place[node]
            values[at] = value[node]
            if not children:
                continue
            while first_free < len(check) and check[first_free] != -1:
                first_free += 1
            # a single child fills the first gap; larger families look from where there was room of late
            start, tries = max(first_free if len(children) == 1 else hint, first_free, children[0] + 1), 0
            while True:
                offset = start - children[0]
                while offset + 256 >= len(check):
                    base.extend([0] * len(base)), check.extend([-1] * len(check)), values.extend([-1] * len(values))
                if all(check[offset + c] == -1 for c in children):
                    break
                start, tries = start + 1, tries + 1
            if tries > 64:
                hint = start - 32
            base[at] = offset
            for c in children:
                check[offset + c] = at
                place[tree[node][c]] = offset + c
                todo.append(tree[node][c])
        # any state plus any byte stays inside
        pad = 257
        self.base, self.check, self.value = base + [0] * pad, check + [-1] * pad, values + [-1] * pad

    def find(self, key: bytes) -> int:
        node = 0
        for byte in key:
            to = self.base[node] + byte
            if self.check[to] != node:
                return -1
            node = to
        return self.value[node]


class Vocabulary:
    """Pieces with log scores, their trie, and the memory of chunks already segmented."""

    def __init__(self, names: list[str], scores: list[float], kinds: list[int], ranks: bool = False):
        self.names, self.kinds = names, kinds
        usable = [i for i, k in enumerate(kinds) if k in (NORMAL, USER)]
        if ranks:
            total = math.log(sum(1 / (1 - scores[i]) for i in usable))
            self.scores = [-math.log(1 - s) - total if k in (NORMAL, USER) else 0.0 for s, k in zip(scores, kinds)]
        else:
            self.scores = list(scores)
        top = max((self.scores[i] for i in usable), default=0.0)
        for i in usable:
            if kinds[i] == USER:
                self.scores[i] = len(names[i]) * top - 0.1
        self.unknown_score = min((self.scores[i] for i in usable if kinds[i] == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        self.bytes_ = {int(names[i][1:-1], 16): i for i, k in enumerate(kinds) if k == BYTE}
        keys = {names[i].replace(MARK, " ").encode(): i for i in usable}
        self.trie = DoubleArray(keys)
        # together[a, b]: some piece has byte b right after byte a, or b goes on with a character
        self.together = np.zeros((256, 256), bool)
        self.together[:, 0x80:0xC0] = True
        for key in keys:
            raw = np.frombuffer(key, np.uint8)
            self.together[raw[:-1], raw[1:]] = True
        decoded = [b"" if k in (CONTROL, UNUSED) else bytes([int(x[1:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else x.replace(MARK, " ").encode() for x, k in zip(names, kinds)]
        self.spelled = np.frombuffer(b"".join(decoded), np.uint8)
        self.spelled_at = np.zeros(len(decoded) + 1, np.int64)
        np.cumsum([len(x) for x in decoded], out=self.spelled_at[1:])
        self.arrays = [np.array(x, np.int32) for x in (self.trie.base, self.trie.check, self.trie.value)]
        self.score_array = np.array(self.scores)
        self.forget()

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> Vocabulary:
        return cls(*read_model(path))

    def forget(self) -> None:
        # hashes of chunks, rising, and the number of each in the pool: 12 bytes a chunk, a tenth of what a dictionary takes
        self.known, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pool, self.pool_at = array.array("i"), array.array("q", [0])

    def segment(self, chunk: bytes) -> list[int]:
        """Viterbi over one chunk, markers being spaces."""
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(chunk)
        best, came, by = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        at = 0
        while at < n:
            lead = chunk[at]
            step = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            if at + step > n:
                step = n - at
            so_far, node, i, single = best[at], 0, at, False
            while i < n:
                to = base[node] + chunk[i]
                if check[to] != node:
                    break
                node = to
                i += 1
                piece = value[node]
                if piece >= 0:
                    score = so_far + scores[piece]
                    if score > best[i]:
                        best[i], came[i], by[i] = score, at, piece
                    if i - at == step:
                        single = True
            if not single:
                score = so_far + self.unknown_score
                if score > best[at + step]:
                    best[at + step], came[at + step], by[at + step] = score, at, -1
            at += step
        out: list[int] = []
        at = n
        while at > 0:
            if by[at] >= 0:
                out.append(by[at])
            elif self.bytes_:
                out.extend(self.bytes_[b] for b in reversed(chunk[came[at] : at]))
            else:
                out.append(self.unknown)
            at = came[at]
        return out[::-1]

    def segment_many(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> list[list[int]]:
        """Viterbi over many short chunks at once, as `segment` does it for each."""
        base, check, value = self.arrays
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        n, wide = len(length), int(length[0]) if len(length) else 0
        block = np.zeros((n, wide + 1), np.int32)
        inside = np.arange(wide)[None, :] < length[:, None]
        block[:, :wide][inside] = data[tx.take_ranges(begin, length)]
        best = np.full((n, wide + 4), -np.inf)
        came, by = np.zeros((n, wide + 4), np.int32), np.full((n, wide + 4), -1, np.int32)
        best[:, 0] = 0.0
        for at in range(wide):
            rows = np.flatnonzero(best[: np.searchsorted(-length, -at, "left"), at] > -np.inf)
            if not len(rows):
                continue
            lead = block[rows, at]
            step = np.minimum(np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))), length[rows] - at)
            single = np.zeros(len(rows), bool)
            own, node, i = np.arange(len(rows)), np.zeros(len(rows), np.int32), at
            while len(own):
                there = length[rows[own]] > i
                own, node = own[there], node[there]
                to = base[node] + block[rows[own], i]
                there = check[to] == node
                own, node, i = own[there], to[there], i + 1
                piece = value[node]
                hit = piece >= 0
                who, piece = own[hit], piece[hit]
                single[who[step[who] == i - at]] = True
                r = rows[who]
                score = best[r, at] + self.score_array[piece]
                better = score > best[r, i]
                r = r[better]
                best[r, i], came[r, i], by[r, i] = score[better], at, piece[better]
            r, to = rows[~single], at + step[~single]
            score = best[r, at] + self.unknown_score
            better = score > best[r, to]
            r, to = r[better], to[better]
            best[r, to], came[r, to], by[r, to] = score[better], at, -1
        out = np.full((n, wide), -1, np.int32)
        rows, at, k, spelled = np.arange(n), length.copy(), wide, np.zeros(n, bool)
        while len(rows):
            k -= 1
            piece = by[rows, at]
            spelled[rows[piece < 0]] = True
            out[rows, k] = piece
            at = came[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        result: list[list[int]] = [[]] * n
        counts = (out >= 0).sum(axis=1)
        for row, (where, ids, count, odd) in enumerate(zip(order.tolist(), out.tolist(), counts.tolist(), spelled.tolist())):
            if odd:
                result[where] = self.segment(data[begin[row] : begin[row] + length[row]].tobytes())
            else:
                result[where] = ids[wide - count :]
        return result

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their ranges; an empty text has none."""
        column = pc.replace_substring(column, MARK, " ")
        column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(" ", column, ""))
        data, offsets = tx.buffers(column)
        start = np.zeros(len(data), bool)
        start[1:] = ~self.together.reshape(-1)[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        start[offsets[:-1][offsets[:-1] < len(data)]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))
        hashes = tx.mix(tx.hash_spans(data, begin, end))
        own, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.known, own)
        near = np.minimum(at, max(len(self.known) - 1, 0))
        numbers = np.where(self.known[near] == own, self.numbers[near], -1) if len(self.known) else np.full(len(own), -1, np.int32)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            first, length = begin[sample[new]], (end - begin)[sample[new]]
            short = length <= 48
            made: list = [None] * len(new)
            where = np.flatnonzero(short)
            for a in range(0, len(where), TOGETHER):
                some = where[a : a + TOGETHER]
                for j, ids in zip(some.tolist(), self.segment_many(data, first[some], length[some])):
                    made[j] = ids
            for j in np.flatnonzero(~short).tolist():
                made[j] = self.segment(data[first[j] : first[j] + length[j]].tobytes())
            numbers[new] = np.arange(len(new)) + len(self.pool_at) - 1
            self.known, self.numbers = np.insert(self.known, at[new], own[new]), np.insert(self.numbers, at[new], numbers[new])
            for ids in made:
                self.pool.extend(ids)
                self.pool_at.append(len(self.pool))
        pool, pool_at = np.frombuffer(self.pool, np.int32) if len(self.pool) else np.zeros(0, np.int32), np.frombuffer(self.pool_at, np.int64)
        first, length = pool_at[numbers][which], (pool_at[numbers + 1] - pool_at[numbers])[which]
        ids = pool[tx.take_ranges(first, length)]
        per_text = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(length, out=per_text[1:])
        del pool, pool_at
        return ids, per_text[np.searchsorted(begin, offsets)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of id ranges: markers become spaces, the first of them goes, broken UTF-8 becomes U+FFFD."""
        length = np.diff(self.spelled_at)[ids]
        data = self.spelled[tx.take_ranges(self.spelled_at[:-1][ids], length)]
        where = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(length, out=where[1:])
        offsets = where[at]
        lead = np.zeros(len(data), bool)
        begin = offsets[:-1][np.diff(offsets) > 0]
        lead[begin] = data[begin] == 32
        gone = np.zeros(len(data) + 1, np.int64)
        np.cumsum(lead, out=gone[1:])
        data, offsets = data[~lead], (offsets - gone[offsets]).astype(np.int32)
        out = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([x.decode("utf-8", "replace") for x in out.cast(pa.binary()).to_pylist()], pa.string())
        return out


def in_worker(held) -> Vocabulary:
    """The broadcast model as this worker's vocabulary, built once in a Python process."""
    made = _built.get(held.value[0])
    if made is None:
        _built.clear()
        made = _built[held.value[0]] = Vocabulary(*held.value[1])
    return made


_built: dict = {}


def share(spark, path: str):
    return spark.sparkContext.broadcast((path, read_model(path)))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL_PATH, *more: str) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) of every row; round_trip says that decoding gives the text back.

    A null or empty text has no ids; U+2581 in a text is the space marker, so it comes back as a space.
    Repeated rows give repeated results, an empty table an empty one; other columns are dropped unless
    named in `more`.
    """
    held = share(docs.sparkSession, path)

    def make(batch: pa.RecordBatch) -> dict:
        vocabulary = in_worker(held)
        column = tx.clean(batch.column(1))
        ids, at = vocabulary.encode(column)
        same = pc.equal(vocabulary.decode(ids, at), pc.replace_substring(column, MARK, " "))
        return {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), "n_ids": np.diff(at), "round_trip": same, **{c: batch.column(2 + i) for i, c in enumerate(more)}}

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    return per_slice(texts(docs, id_col, text_col, *more), make, f"doc_id long, ids array<int>, n_ids long, round_trip boolean{kinds}")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) of every row with ids; null ids give a null text, ids outside the vocabulary raise."""
    held = share(encoded.sparkSession, path)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            at = np.zeros(len(lists) + 1, np.int64)
            np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), out=at[1:])
            text = in_worker(held).decode(np.asarray(flat, np.int64), at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.string()))], ["doc_id", "text"])

    return encoded.select(integer(F.col(id_col)).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")

"""Sorted-string-table shards of token ids or any binary value, keyed by document id.

A shard is one file: data blocks, block index, Bloom filter, footer.  Keys are 8 bytes big-endian with the
sign turned, so byte order is number order; inside a block a key keeps only what it doesn't share with
the one before, with a restart every 16 entries.  Blocks are compressed with zstd.  The sparse index holds
the last key of each block; a lookup asks the Bloom filter, bisects the index, reads one block (and the
next ones while the key goes on) and bisects its restarts.

Lists of token ids are stored as uint16 or uint32, strings as their UTF-8 bytes.
Files are written under a name of their own and moved into place; the manifest lists those that count, so
a task that is run twice leaves an unlisted file and no damage.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import pieces
from graphloom.llm import text as tx
from graphloom.llm.common import cut, integer, per_slice, scratch, texts

MAGIC = b"GLSSTv01"
FOOTER = struct.Struct("<QQQQQQII8s")
BLOCK_BYTES, RESTART, BITS_PER_KEY, PROBES = 1 << 16, 16, 10, 7
#: Packed values of a shard, about.
SHARD_BYTES = 32 << 20


def key_bytes(number: int) -> bytes:
    return ((number + (1 << 63)) & (2**64 - 1)).to_bytes(8, "big")


def key_number(key: bytes) -> int:
    return int.from_bytes(key, "big") - (1 << 63)


def pack_value(value) -> bytes:
    """One tag byte and the value: n nothing, b bytes, h uint16 ids, i uint32 ids."""
    if value is None:
        return b"n"
    if isinstance(value, str):
        return b"b" + value.encode()
    if isinstance(value, (bytes, bytearray, memoryview)):
        return b"b" + bytes(value)
    ids = np.asarray(value, np.int64)
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32):
        raise ValueError("token ids lie in 0 .. 2**32 - 1")
    return b"h" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"i" + ids.astype("<u4").tobytes()


def unpack_value(raw: bytes):
    """None, bytes or a list of ids."""
    if raw[:1] == b"n":
        return None
    if raw[:1] == b"b":
        return raw[1:]
    return np.frombuffer(raw[1:], "<u2" if raw[:1] == b"h" else "<u4").tolist()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = tx.mix_one(int.from_bytes(key, "big"))
    step = tx.mix_one(h) | 1
    return [(h + i * step & (2**64 - 1)) % bits for i in range(PROBES)]


class Writer:
    """Writes entries that come in key order to an open binary stream."""

    def __init__(self, sink, block_bytes: int = BLOCK_BYTES):
        self.sink, self.block_bytes = sink, block_bytes
        self.at, self.count = 0, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.zip = zstandard.ZstdCompressor(level=1)
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.entries, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must not fall")
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.entries = key, self.entries + 1
        self.keys.append(key)
        self.count += 1
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _write(self, raw: bytes) -> tuple[int, int]:
        at = self.at
        self.sink.write(raw)
        self.at += len(raw)
        return at, len(raw)

    def _flush(self) -> None:
        if not self.entries:
            return
        raw = bytes(self.block) + struct.pack(f"<{len(self.restarts)}I", *self.restarts) + struct.pack("<I", len(self.restarts))
        packed = self.zip.compress(raw)
        at, size = self._write(packed + struct.pack("<I", zlib.crc32(packed)))
        self.index.append((self.last, at, size))
        self._open()

    def close(self) -> dict:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QI", at, size) for k, at, size in self.index)
        bits = max(64, self.count * BITS_PER_KEY)
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index_at, index_size = self._write(index)
        bloom_at, bloom_size = self._write(bytes(bloom))
        self._write(FOOTER.pack(index_at, index_size, bloom_at, bloom_size, self.count, bits, len(self.index), zlib.crc32(index + bytes(bloom)), MAGIC))
        return {"n": self.count, "n_blocks": len(self.index), "n_bytes": self.at}


class Reader:
    """Looks keys up in an open random-access file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        footer = self._read(size - FOOTER.size, FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, self.count, self.bits, _, crc, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        index, self.bloom = self._read(index_at, index_size), self._read(bloom_at, bloom_size)
        if zlib.crc32(index + self.bloom) != crc:
            raise ValueError("index or Bloom filter is damaged")
        self.last, self.place, at = [], [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.last.append(index[at : at + n])
            self.place.append(struct.unpack_from("<QI", index, at + n))
            at += n + 12
        self.unzip = zstandard.ZstdDecompressor()
        self.held: tuple[int, bytes] = (-1, b"")

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def _block(self, number: int) -> bytes:
        if self.held[0] != number:
            raw = self._read(*self.place[number])
            if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
                raise ValueError("a block is damaged")
            self.held = (number, self.unzip.decompress(raw[:-4]))
        return self.held[1]

    def _entries(self, raw: bytes, at: int, end: int):
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + n]
            yield key, raw[at + n : at + n + size]
            at += n + size

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key, in the order they were written; none if it isn't there."""
        if not self.may_hold(key):
            return []
        found, number = [], bisect.bisect_left(self.last, key)
        while number < len(self.last):
            raw = self._block(number)
            n = struct.unpack("<I", raw[-4:])[0]
            end = len(raw) - 4 - 4 * n
            restarts = struct.unpack_from(f"<{n}I", raw, end)
            # the last restart whose key is below the wanted one
            first = max(0, bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(raw, at, end))[0]) - 1)
            for k, value in self._entries(raw, restarts[first], end):
                if k > key:
                    return found
                if k == key:
                    found.append(value)
            number += 1
        return found

    def scan(self):
        """All (key, value) in order."""
        for number in range(len(self.place)):
            raw = self._block(number)
            yield from self._entries(raw, 0, len(raw) - 4 - 4 * struct.unpack("<I", raw[-4:])[0])


def default_root(spark: SparkSession) -> str:
    """The file system that Spark itself takes for a path without a scheme, as a URI; "" for the local one."""
    root = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or ""
    return "" if root.startswith("file:") else root.rstrip("/")


def _target(uri: str, root: str = "") -> tuple[pafs.FileSystem, str]:
    """File system and path; a path without a scheme lies where Spark itself would put it."""
    if "://" not in uri and not uri.startswith("file:"):
        if not root:
            return pafs.LocalFileSystem(), uri
        uri = f"{root}/{uri.lstrip('/')}"
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def packed(df: DataFrame, key_col: str, value_col: str) -> DataFrame:
    """(key, value) with the value as bytes, packed before anything is sorted; rows without an integer key are left out."""
    rows = df.select(integer(F.col(key_col)).alias("key"), F.col(value_col).alias("value")).where("key is not null")

    def run(batches):
        for batch in batches:
            values = batch.column(1)
            if pa.types.is_list(values.type):
                flat, at = np.asarray(values.flatten()), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(values), 0)))
                made = [pack_value(flat[a:b] if there else None) for a, b, there in zip(at, at[1:], values.is_valid().to_pylist())]
            else:
                made = [pack_value(v) for v in values.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["key", "value"])

    return rows.mapInArrow(run, "key long, value binary")


def write(df: DataFrame, folder: str, key_col: str = "doc_id", value_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards to a shared folder: the manifest (path, min_key, max_key, n, n_blocks, n_bytes), one row a shard.

    Values are strings, bytes or lists of token ids; a shard takes about `shard_bytes` of them.  Rows without an
    integer key are left out; a null value is kept as such; repeated keys keep all their values, and one that
    fills more than a shard goes on in the next; an empty table writes nothing; other columns are ignored.
    """
    return write_packed(packed(df, key_col, value_col), folder, shard_bytes)


def write_packed(df: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`write` of rows (key, value) whose values are packed.

    They are kept in the shared folder while keys are ranged and sorted, so values are made once.  The manifest
    is kept by a checkpoint: it is written once and always names the files of the tasks that counted.
    """
    spark = df.sparkSession
    table = scratch(spark, "packed")
    df.write.parquet(table)
    rows = spark.read.parquet(table)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()[0]
    shards = rows.repartitionByRange(max(1, -(-size // shard_bytes)), "key", F.xxhash64("value")).sortWithinPartitions("key", "value")
    root = default_root(spark)

    def run(batches):
        fs, at = _target(folder, root)
        fs.create_dir(at, recursive=True)
        name = f"{at}/{uuid.uuid4().hex}"
        ends: list[int] = []
        with fs.open_output_stream(f"{name}.part") as sink:
            writer = Writer(sink)
            for batch in batches:
                keys = batch.column(0).to_pylist()
                for key, value in zip(keys, batch.column(1).to_pylist()):
                    writer.add(key_bytes(key), value)
                ends = [ends[0] if ends else keys[0], keys[-1]] if keys else ends
            facts = writer.close()
        if not ends:
            fs.delete_file(f"{name}.part")
            return
        fs.move(f"{name}.part", f"{name}.sst")
        yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name.rsplit('/', 1)[-1]}.sst"], "min_key": [ends[0]], "max_key": [ends[1]], **{k: [v] for k, v in facts.items()}})

    manifest = cut(shards.mapInArrow(run, "path string, min_key long, max_key long, n long, n_blocks long, n_bytes long"))
    remove(spark, table)
    return manifest


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table of ours that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def lookup(manifest: DataFrame, keys: list[int]) -> dict[int, list]:
    """Values of some keys in order, by the shards whose key range holds them; none for a key that isn't there."""
    root = default_root(manifest.sparkSession)
    found: dict[int, list] = {k: [] for k in keys}
    wanted = sorted(found)
    for shard in manifest.orderBy("min_key").collect():
        own = wanted[bisect.bisect_left(wanted, shard.min_key) : bisect.bisect_right(wanted, shard.max_key)]
        if own:
            fs, path = _target(shard.path, root)
            with fs.open_input_file(path) as source:
                reader = Reader(source)
                for k in own:
                    found[k] += reader.get(key_bytes(k))
    return {k: [unpack_value(v) for v in sorted(values)] for k, values in found.items()}


def looked_up(manifest: DataFrame, finish: Callable[[list[bytes]], pa.Array] | None = None, schema: str = "doc_id long, value binary") -> DataFrame:
    """(doc_id, value) of every key of every shard, each found again by a lookup; value is packed, or what `finish` makes of it."""
    root = default_root(manifest.sparkSession)
    finish = finish or (lambda values: pa.array(values, pa.binary()))
    names = [f.split()[0] for f in schema.split(", ")]

    def found(reader: Reader):
        keys, values, size = [], [], 0
        for key in dict.fromkeys(k for k, _ in reader.scan()):
            own = reader.get(key)
            keys += [key_number(key)] * len(own)
            values += own
            size += sum(map(len, own))
            if size > 1 << 20:
                yield keys, values
                keys, values, size = [], [], 0
        yield keys, values

    def run(batches):
        for batch in batches:
            for name, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = _target(name, root)
                with fs.open_input_file(path) as source:
                    seen = 0
                    for keys, values in found(Reader(source)):
                        seen += len(keys)
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), finish(values)], names)
                if seen != n:
                    raise RuntimeError(f"{path}: wrote {n} entries, found {seen}")

    return manifest.select("path", "n").mapInArrow(run, schema)


def write_and_verify(df: DataFrame, folder: str | None = None, key_col: str = "doc_id", value_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards, then looks every key up again: (doc_id, n_bytes, md5) of each stored value, null for a null value."""
    found = looked_up(write(df, folder or scratch(df.sparkSession, "sstable"), key_col, value_col, shard_bytes))
    there = F.substring("value", 1, 1) != F.lit(b"n")
    return found.select("doc_id", F.when(there, F.octet_length("value") - 1).cast("long").alias("n_bytes"), F.when(there, F.md5(F.expr("substring(value, 2)"))).alias("md5"))


def token_shards(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, path: str = pieces.MODEL_PATH) -> DataFrame:
    """Writes every document's token ids and reads them back by lookup: (doc_id, n_bytes, md5).

    n_bytes and md5 are those of the text that the stored ids decode to.  A null text has no ids and decodes to
    "", as an empty one does; U+2581 comes back as a space.  Rows without an integer doc_id are left out; see `write`.
    """
    held = pieces.share(docs.sparkSession, path)

    def make(batch: pa.RecordBatch) -> dict:
        ids, at = pieces.in_worker(held).encode(tx.clean(batch.column(1)))
        wide = b"i" if ids.max(initial=0) >> 16 else b"h"
        raw, size = ids.astype("<u4" if wide == b"i" else "<u2").tobytes(), 4 if wide == b"i" else 2
        return {"key": batch.column(0), "value": [wide + raw[size * a : size * b] for a, b in zip(at.tolist(), at[1:].tolist())]}

    def text(values: list[bytes]) -> pa.Array:
        ids = [np.asarray(unpack_value(v), np.int64) for v in values]
        return pieces.in_worker(held).decode(np.concatenate([np.zeros(0, np.int64), *ids]), np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64))

    rows = per_slice(texts(docs, id_col, text_col).where("doc_id is not null"), make, "key long, value binary")
    found = looked_up(write_packed(rows, folder or scratch(docs.sparkSession, "sstable"), shard_bytes), text, "doc_id long, text string")
    return found.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("md5"))


SQL = "SELECT doc_id, CAST(strlen(replace(coalesce(text, ''), chr(9601), ' ')) AS BIGINT) AS n_bytes, md5(replace(coalesce(text, ''), chr(9601), ' ')) AS md5 FROM documents WHERE doc_id IS NOT NULL"

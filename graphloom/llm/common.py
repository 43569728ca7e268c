"""What the operators share: tables, lineage cuts, samples and Arrow plumbing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a single machine one of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="graphloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, kept in the shared folder, safe from lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(shared_dir(spark), f"graphloom-{name}-{uuid.uuid4().hex}")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or the first variation of it that clashes with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def integer(column: F.Column) -> F.Column:
    """The column as a 64-bit integer, null where it isn't one: what the operators take for an id."""
    return column.try_cast("long")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the needed columns, under the names doc_id and text whatever else the table holds; an id that is no integer is null."""
    extra = [docs[c] for c in more]
    return docs.select(integer(docs[id_col]).alias("doc_id"), docs[text_col].cast("string").alias("text"), *extra)


def tidy() -> None:
    """Gives memory that a worker has freed back to the system: Spark keeps idle workers, and they would hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def per_slice(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str, text_col: str = "text", rows: int = 4096) -> DataFrame:
    """mapInArrow with batches cut into slices of bounded text; `make` gives a slice's output columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = tx.clean(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in tx.slices(column):
                for c in range(a, b, rows):
                    made = make(batch.slice(c, min(b, c + rows) - c))
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip((made[f.name] for f in out), out)], schema=out)
        tidy()

    return df.mapInArrow(run, schema)


def keep_rows(docs: DataFrame, mask: Callable[[pa.Array], "object"], text_col: str = "text") -> DataFrame:
    """The rows whose text `mask` accepts, all columns unchanged: one pass, no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = tx.clean(batch.column(at))
            for a, b in tx.slices(column):
                for c in range(a, b, 4096):
                    d = min(b, c + 4096)
                    yield batch.slice(c, d - c).filter(pa.array(mask(column.slice(c, d - c)), pa.bool_()))
        tidy()

    return docs.mapInArrow(run, docs.schema)


def hashed_fraction(col: F.Column, fraction: float, seed: int) -> F.Column:
    """True for about `fraction` of the values, the same ones on every run and machine."""
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, max(0.0, fraction)) * (1 << 30)))

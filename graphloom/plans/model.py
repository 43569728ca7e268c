"""The code graph as six narrow tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.plans.session import delete, exists

DDL = {
    "nodes": "node_seq BIGINT, path STRING, type STRING, category STRING, mtime DOUBLE, size BIGINT, description STRING, coverage_pct DOUBLE, complexity INT, cognitive INT, package STRING",
    "imports": "path STRING, edge_seq INT, to_path STRING, raw_specifier STRING, type STRING, is_style BOOLEAN, symbols ARRAY<STRING>, is_external BOOLEAN, version STRING, is_workspace BOOLEAN, workspace_package STRING",
    "exports": "path STRING, exp_seq INT, name STRING, doc STRING, flags ARRAY<STRING>, signature STRING",
    "tags": "path STRING, tag_seq INT, name STRING, kind STRING",
    "functions": "path STRING, fn_seq INT, name STRING, line INT, complexity INT, cognitive INT",
    "calls": "path STRING, call_seq INT, from_fn STRING, to_fn STRING, to_file STRING",
}


@dataclass(frozen=True)
class CodeGraph:
    """One row a file in `nodes`, child tables keyed by path; `*_seq` gives "first" and "last" a meaning.

    `imports.symbols` null means the whole module, an empty array no symbol.  `to_path` of an external
    import names no node.  `commits` (path, author, ts, log_seq) is optional.
    """

    nodes: DataFrame
    imports: DataFrame
    exports: DataFrame
    tags: DataFrame
    functions: DataFrame
    calls: DataFrame
    commits: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_tables(self, **tables: DataFrame) -> CodeGraph:
        return replace(self, **tables)

    def internal(self) -> DataFrame:
        """(src, dst, edge_seq, symbols, type) of imports between files of the graph."""
        inner = self.imports.where(~F.coalesce("is_external", F.lit(False)))
        nodes = self.nodes.select(F.col("path").alias("dst"))
        return inner.select(F.col("path").alias("src"), F.col("to_path").alias("dst"), "edge_seq", "symbols", "type").join(nodes, "dst", "left_semi")

    @classmethod
    def from_rows(cls, spark: SparkSession, **rows) -> CodeGraph:
        """From lists of dicts; missing fields are null, missing tables empty."""
        made = {}
        for name, ddl in DDL.items():
            schema = StructType.fromDDL(ddl)
            made[name] = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows.get(name, [])], schema)
        commits = spark.createDataFrame(rows["commits"], "path STRING, author STRING, ts BIGINT, log_seq BIGINT") if "commits" in rows else None
        return cls(**made, commits=commits)

    def write(self, folder: str) -> None:
        """Parquet, one table a folder; a graph without commits leaves none there."""
        for name in [*DDL, "commits"]:
            if getattr(self, name) is not None:
                getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
            else:
                delete(self.spark, f"{folder}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> CodeGraph:
        tables = {name: spark.read.parquet(f"{folder}/{name}") for name in DDL}
        return cls(**tables, commits=spark.read.parquet(f"{folder}/commits") if exists(spark, f"{folder}/commits") else None)

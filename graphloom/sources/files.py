"""Source trees as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.classify import TYPE_OF

IGNORE_DIRS = ("build", "coverage", "dist", "graphloom-cache", "node_modules", ".cache", ".git", ".next")


@dataclass(frozen=True)
class ScanOptions:
    """Lists given replace the defaults; `more_*` lists are added to them."""

    ignore_dirs: tuple[str, ...] | None = None
    extensions: tuple[str, ...] | None = None
    more_ignore_dirs: tuple[str, ...] = ()
    more_extensions: tuple[str, ...] = ()

    @property
    def ignored(self) -> set[str]:
        return {*(IGNORE_DIRS if self.ignore_dirs is None else self.ignore_dirs), *self.more_ignore_dirs}

    @property
    def allowed(self) -> set[str]:
        return {e.lower() for e in (*(TYPE_OF if self.extensions is None else self.extensions), *self.more_extensions)}


def scan(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """(path, mtime, size, content) of the files under `root`, paths relative to it; ignored folders and other extensions pruned."""
    base = root if ":" in root.split("/")[0] else f"file:{root}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*").load(base)
    tail = base.split(":", 1)[1].rstrip("/").lstrip("/") + "/"
    path = F.element_at(F.split(F.col("path"), tail.replace("\\", "\\\\").replace(".", "\\."), 2), 2)
    extension = F.lower(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(?<=.)(\.[^.]*)$", 1))
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    found = raw.select(path.alias("path"), (F.unix_millis("modificationTime")).cast("double").alias("mtime"), F.col("length").alias("size"), "content")
    return found.where(extension.isin(*options.allowed) & ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in sorted(options.ignored)])))


def changed(files: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or whose mtime or size differ from the nodes of the last build."""
    return files.join(before.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")

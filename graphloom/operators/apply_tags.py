"""Tags for test files: computed in the engine, written only on request."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.tagging import tagged
from graphloom.plans.model import CodeGraph


def preview(graph: CodeGraph, files: DataFrame, overrides: dict[str, str] | None = None, more: dict[str, Callable[[str, list[str]], str]] | None = None) -> DataFrame:
    """(path, strategy, tags, status, content): new content of each test file; status updated, unchanged or skipped.

    Only tags of kind import are written; `files` has path and content.  `more` adds writers, see `tagging.tagged`.
    """
    tests = graph.nodes.where("category = 'test'").select("path")
    tags = graph.tags.where("kind = 'import'").groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    rows = files.select("path", F.col("content").cast("string").alias("content")).join(tests, "path", "left_semi").join(tags, "path", "left").select("path", "content", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content, own in zip(pdf["path"], pdf["content"], pdf["tags"]):
                name, new = tagged(path, content, list(own), overrides, more)
                out.append((path, name, list(own), "skipped" if name is None else "unchanged" if new == content else "updated", new))
            yield pd.DataFrame(out, columns=["path", "strategy", "tags", "status", "content"])

    return rows.mapInPandas(run, "path STRING, strategy STRING, tags ARRAY<STRING>, status STRING, content STRING")


def summary(previewed: DataFrame) -> DataFrame:
    """(status, n)."""
    return previewed.groupBy("status").agg(F.count("*").alias("n"))


def write(previewed: DataFrame, root: str) -> None:
    """Writes updated files below a root on a file system that all executors share, from the tasks that computed them."""
    master = previewed.sparkSession.sparkContext.master
    if not root.startswith("file:") and not master.startswith("local[") and master != "local":
        raise ValueError("name the shared folder as file:/...: on a cluster a plain path is each machine's own")
    root = root.removeprefix("file:")

    def run(rows) -> None:
        for r in rows:
            with open(f"{root}/{r.path}", "w") as f:
                f.write(r.content)

    previewed.where("status = 'updated'").foreachPartition(run)

"""One file in, its facts out: the dispatcher behind the parse step."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from graphloom.functions import parse_python, parse_script, parse_text
from graphloom.functions.classify import DEFAULT, ClassifyConfig, file_type, is_style

Parser = Callable[[str, str, ClassifyConfig], dict]
PARSERS: dict[str, Parser] = {
    "typescript": parse_script.parse, "javascript": parse_script.parse, "go": parse_script.parse_go, "python": parse_python.parse, "css": parse_text.parse_css,
    "scss": parse_text.parse_scss, "less": parse_text.parse_less, "stylus": parse_text.parse_stylus, "markdown": parse_text.parse_markdown, "gherkin": parse_text.parse_gherkin,
    "lua": parse_text.parse_lua, "coffeescript": parse_text.parse_coffee, "livescript": parse_text.parse_livescript,
}
SCHEMA = (
    "path STRING, type STRING, category STRING, mtime DOUBLE, size BIGINT, description STRING, complexity INT, cognitive INT, parse_error STRING, "
    "imports ARRAY<STRUCT<specifier: STRING, type: STRING, symbols: ARRAY<STRING>, is_style: BOOLEAN, is_external: BOOLEAN>>, "
    "exports ARRAY<STRUCT<name: STRING, doc: STRING, flags: ARRAY<STRING>, signature: STRING>>, tags ARRAY<STRUCT<name: STRING, kind: STRING>>, "
    "functions ARRAY<STRUCT<name: STRING, line: INT, complexity: INT, cognitive: INT>>, calls ARRAY<STRUCT<from_fn: STRING, to_fn: STRING, specifier: STRING>>"
)
#: Parse tasks for each core, so that slow files even out.
TASKS_A_CORE = 4
_EMPTY = {"imports": [], "exports": [], "tags": [], "category": "other", "functions": [], "calls": [], "description": None, "complexity": None, "cognitive": None}


def parse_file(path: str, text: str, config: ClassifyConfig = DEFAULT, more: dict[str, Parser] | None = None) -> dict:
    """The facts of one file; a file that can't be parsed is an empty one of category other with the error."""
    kind = file_type(path)
    parser = {**PARSERS, **(more or {})}.get(kind)
    try:
        found = {**_EMPTY, "parse_error": None, **(parser(path, text, config) if parser else {})}
    except Exception as e:
        found = {**_EMPTY, "parse_error": f"{type(e).__name__}: {e}"[:300]}
    found["type"] = kind
    found["imports"] = [{"specifier": i["specifier"], "type": i["type"], "symbols": i.get("symbols"), "is_style": is_style(i["specifier"]), "is_external": i.get("is_external")} for i in found["imports"]]
    found["exports"] = [{k: e.get(k) for k in ("name", "doc", "flags", "signature")} for e in found["exports"] if e.get("name")]
    found["tags"] = [{"name": n, "kind": k} for n, k in dict.fromkeys(map(tuple, found["tags"]))]
    return found


def parse_tasks(spark: SparkSession) -> int:
    """Tasks for work that takes far longer than its bytes tell."""
    return max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parse_table(files: DataFrame, config: ClassifyConfig = DEFAULT, more: dict[str, Parser] | None = None) -> DataFrame:
    """`SCHEMA` rows of files (path, mtime, size, content): each file is parsed on its own, in Arrow batches.

    Files are dealt out to all cores first: a table of few bytes may be read by one task, and parsing takes far longer than reading.
    """
    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rows = []
                for f in batch.slice(a, 256).to_pylist():
                    content = f.pop("content")
                    text = content if isinstance(content, str) else bytes(content or b"").decode("utf-8", "replace")
                    rows.append({**parse_file(f["path"], text, config, more), **f})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    dealt = files.select("path", F.col("mtime").cast("double"), F.col("size").cast("bigint"), "content").repartition(parse_tasks(files.sparkSession), "path")
    return dealt.mapInArrow(run, SCHEMA)

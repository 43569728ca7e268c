"""Token streams of source files and rule blocks of style sheets, for duplicate detection."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.classify import file_type

#: type -> (line comment, block comment)
COMMENTS = {
    **dict.fromkeys(("typescript", "javascript", "go", "scss", "less", "stylus", "livescript"), (r"//[^\n]*", r"/\*.*?\*/")),
    "css": (None, r"/\*.*?\*/"), "python": (r"#[^\n]*", None), "coffeescript": (r"#[^\n]*", r"###.*?###"), "lua": (r"--[^\n]*", r"--\[\[.*?\]\]"), "gherkin": (r"#[^\n]*", None),
}
STYLES = ("css", "scss", "less", "stylus")
STRUCTURAL = ("css", "scss", "less")
LOCK_FILES = frozenset("package-lock.json pnpm-lock.yaml yarn.lock".split())
_OPERATORS = r"===|!==|\.\.\.|=>|==|!=|<=|>=|&&|\|\||::|->|\.\.|\+=|-=|\*=|/="
_TOKEN = re.compile(_OPERATORS + r"|(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d+(?:\.\d+)?)|(?P<str>\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)|\S", re.S | re.A)
KEYWORDS = frozenset(
    "False None True and async await break case catch class const continue def default do elif else end except export false finally for from function if "
    "import in interface is let local new nil not null of or package raise return self struct switch then this throw true try var while yield".split()
)


def strip_comments(text: str, kind: str) -> str:
    """Comments become spaces; line ends stay, so lines keep their numbers."""
    line, block = COMMENTS.get(kind, (None, None))
    for pattern in (block, line):
        if pattern:
            text = re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    return text


def tokenize(text: str, kind: str, ignore_literals: bool = True) -> list[tuple[str, int]]:
    """(token, line): identifiers are ID, and unless literals count, numbers NUM and strings STR."""
    text, out, line, at = strip_comments(text, kind), [], 1, 0
    for m in _TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        token = m.group()
        if m.lastgroup == "id":
            token = token if token in KEYWORDS else "ID"
        elif ignore_literals and m.lastgroup in ("num", "str"):
            token = m.lastgroup.upper()
        out.append((token, line))
    return out


def token_table(files: DataFrame, ignore_literals: bool = True) -> DataFrame:
    """(family, file, pos, text, line) of files (path, content); styles that are compared by rule, and lock files, are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                kind = file_type(path)
                if kind in STRUCTURAL or kind == "unknown" or path.rsplit("/", 1)[-1] in LOCK_FILES:
                    continue
                text = content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
                family = "style" if kind in STYLES else "code"
                rows += [(family, path, i, t, n) for i, (t, n) in enumerate(tokenize(text, kind, ignore_literals))]
            yield pd.DataFrame(rows, columns=["family", "file", "pos", "text", "line"])

    return files.select("path", "content").mapInPandas(run, "family STRING, file STRING, pos INT, text STRING, line INT")


def cached_tokens(files: DataFrame, before: DataFrame | None, ignore_literals: bool = True) -> DataFrame:
    """(family, file, pos, text, line, mtime, size, ignore_literals) of files (path, mtime, size, content).

    Tokens of `before`, such a table of an earlier scan, are taken over for files whose time, size and setting are
    the same; the others are read anew, and files that are gone drop out.  Write it as Parquet to keep it.
    """
    stamp = files.select(F.col("path").alias("file"), "mtime", "size")
    key = ["file", "mtime", "size"]
    fresh = files
    if before is not None:
        same = before.where(F.col("ignore_literals") == ignore_literals).join(stamp, key, "left_semi")
        fresh = files.join(same.select(F.col("file").alias("path")).distinct(), "path", "left_anti")
    new = token_table(fresh, ignore_literals).join(stamp, "file").withColumn("ignore_literals", F.lit(ignore_literals))
    return new if before is None else new.unionByName(same.select(new.columns))


def rule_blocks(text: str, file: str = "") -> list[dict]:
    """Rules with declarations: place, lines and ordered signature; nested rules are rules of their own."""
    text = re.sub(r"/\*.*?\*/|(?<![:\w])//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    out, stack, part, begin, line = [], [], "", 1, 1
    for i, c in enumerate(text):
        if c in "{};":
            piece = part.strip()
            if c == "{":
                stack.append([begin, [], line, piece.startswith("@")])
            else:
                if piece and stack and ":" in piece and not piece.startswith("@"):
                    prop, value = piece.split(":", 1)
                    stack[-1][1].append(f"{prop.strip().lower()}:{re.sub(chr(92) + 's+', ' ', value.strip())}")
                    stack[-1][2] = line
                if c == "}" and stack:
                    start, declarations, end, at_rule = stack.pop()
                    if declarations and not at_rule:
                        out.append({"file": file, "start_line": start, "end_line": end, "lines": end - start + 1, "signature": ";".join(declarations), "decl_count": len(declarations)})
            part = ""
        else:
            if not part.strip():
                begin = line + (c == "\n")
            part += c
        line += c == "\n"
    return out


def block_table(files: DataFrame) -> DataFrame:
    """Rule blocks of the style sheets among files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [b for path, content in zip(pdf["path"], pdf["content"]) if file_type(path) in STRUCTURAL for b in rule_blocks(content if isinstance(content, str) else bytes(content).decode("utf-8", "replace"), path)]
            yield pd.DataFrame(rows, columns=["file", "start_line", "end_line", "lines", "signature", "decl_count"])

    return files.select("path", "content").mapInPandas(run, "file STRING, start_line INT, end_line INT, lines INT, signature STRING, decl_count INT")

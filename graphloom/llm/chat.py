"""Chat formatting by incremental black-box rendering.

A template is any function from a list of {"role", "content"} to a string.  It is called for every
prefix of a conversation; what consecutive outputs have in common tells where each turn lies: turn k's
span is what rendering k + 1 turns has beyond rendering k turns.  A closing text that ends every output and so
moves to the end is no rewriting; anything else that changes in the earlier output means that the template rewrites history.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import integer

Template = Callable[[list[dict]], str]


def chatml(messages: list[dict]) -> str:
    return "".join(f"<|im_start|>{m['role']}\n{m['content']}<|im_end|>\n" for m in messages)


def instruct(messages: list[dict]) -> str:
    """The system turn is folded into the first user turn; each assistant turn closes the text."""
    out, system = "<s>", ""
    for m in messages:
        if m["role"] == "system":
            system += f"<<SYS>>\n{m['content']}\n<</SYS>>\n\n"
        elif m["role"] == "user":
            out += f"[INST] {system}{m['content']} [/INST]"
            system = ""
        else:
            out += f" {m['content']} "
    return out + (f"[INST] {system}" if system else "") + "</s>"


def last_answer_only(messages: list[dict]) -> str:
    """Keeps only the newest assistant turn's content: earlier answers are replaced, so history is rewritten."""
    newest = max((i for i, m in enumerate(messages) if m["role"] == "assistant"), default=-1)
    return "".join(f"<{m['role']}>{m['content'] if m['role'] != 'assistant' or i == newest else '...'}</{m['role']}>" for i, m in enumerate(messages))


TEMPLATES: dict[str, Template] = {"chatml": chatml, "instruct": instruct, "last_answer_only": last_answer_only}


def common_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix, by bisection over slice comparisons."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def common_suffix(a: str, b: str) -> int:
    """Length of the longest common suffix."""
    return common_prefix(a[::-1], b[::-1])


def _rendered(render: Template, messages: list[dict]) -> str | None:
    try:
        return render(messages)
    except Exception:
        return None


def spans(messages: list[dict], render: Template) -> tuple[str | None, list[tuple[int | None, int | None, bool | None]]]:
    """The last output and, for each turn, (start, end, rewrites) in the output of the prefix that ends with it.

    `rewrites` says that rendering this turn changed what stood before it, beyond moving the closing text: a
    text that ends every output, that of no turns included.  A turn whose own output or the one before it is
    missing because the template raised has None for all three; a template that raises for no turns renders nothing.
    """
    before = _rendered(render, [])
    closing = before  # the common end of all outputs
    before = before or ""
    found: list[list] = []
    for k in range(1, len(messages) + 1):
        now = _rendered(render, messages[:k])
        if now is not None:
            closing = now if closing is None else closing[len(closing) - common_suffix(closing, now) :]
        if now is None or before is None:
            found.append([None, None, 0])
        else:
            same = common_prefix(before, now)
            found.append([same, len(now), len(before) - same])
        before = now
    out = []
    for start, end, tail in found:
        # what is left of the old output ends the new one if it is part of the closing text
        moved = 0 < tail <= len(closing or "") and end - start >= tail
        out.append((None, None, None) if start is None else (start, end - tail if moved else end, tail > 0 and not moved))
    return before, out


def format_conversations(turns: DataFrame, templates: dict[str, Template] | None = None) -> DataFrame:
    """(conv_id, template, turn, role, start, end, rewrites, length, text): a row for each turn and template.

    Turns go by their number, ties by role and text; a null number comes first, null role or text count as
    "".  Rows without an integer conv_id are left out; repeated rows are repeated turns; `text` is the whole rendered
    conversation on its last turn and null elsewhere; other columns are ignored.  Where a template raises for a
    prefix, that turn and the next, which can't be compared, have null start, end and rewrites; if it raises for
    the whole conversation, length and text are null too.
    """
    templates = dict(templates or TEMPLATES)
    turn = F.struct(integer(F.col("turn")).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.select(integer(F.col("conv_id")).alias("conv_id"), turn.alias("t")).where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    kinds = [("conv_id", pa.int64()), ("template", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rewrites", pa.bool_()), ("length", pa.int64()), ("text", pa.string())]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: list[list] = [[] for _ in kinds]
                for conv, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    messages = [{"role": t["role"], "content": t["text"]} for t in own]
                    for name, render in templates.items():
                        text, found = spans(messages, render)
                        for k, (t, (start, end, rewrites)) in enumerate(zip(own, found)):
                            row = (conv, name, t["turn"], t["role"], start, end, rewrites, len(text) if text is not None else None, text if k == len(own) - 1 else None)
                            for x, to in zip(row, out):
                                to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(out, kinds)], [n for n, _ in kinds])

    return grouped.mapInArrow(run, "conv_id long, template string, turn long, role string, start long, end long, rewrites boolean, length long, text string")

"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, then that reply, the only trainable
text. Turns after the last reply form one more example without trainable text, so that no turn is lost. Examples of one
conversation grow with the square of its turns; they are made one after another while its turns stream by.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxlake.llm.common import arrow_batches, text_or_empty, written

# The template's control strings.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("<s> ", " </s>")}
OTHER = ("[ROLE:", "] ", " [/ROLE]")
_TAIL = r"/?s>|/?(?:INST|SYS|ROLE)"
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_TAIL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_TAIL})")
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]|<s> (?P<assistant>.*?) </s>|\[ROLE:(?P<role>(?:[^\]\\]|\\.)*)\] (?P<other>.*?) \[/ROLE\]", re.S)
FLUSH_CHARS = 4_000_000


def escape(text: str) -> str:
    """No control string is left in the result: a backslash goes behind the opening character of each."""
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def turn_marks(role: str) -> tuple[str, str]:
    if role in MARKS:
        return MARKS[role]
    return OTHER[0] + re.sub(r"([\\\]])", r"\\\1", escape(role)) + OTHER[1], OTHER[2]


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted example."""
    turns = []
    for m in _TURN.finditer(formatted):
        if m["role"] is not None:
            turns.append((unescape(re.sub(r"\\([\\\]])", r"\1", m["role"])), unescape(m["other"])))
        else:
            turns.append((m.lastgroup, unescape(m[m.lastgroup])))
    return turns


def expand_turns(rows: Iterator[tuple[int, str, str]]) -> Iterator[tuple[int, int, str, int, int, bool]]:
    """(conv_id, example, text, loss_start, loss_end, last) from (conv_id, role, text) in order."""
    conv, parts, size, n, trailing, held = None, [], 0, 0, False, None

    def close():
        if held is not None and not trailing:
            yield (*held, True)
        else:
            if held is not None:
                yield (*held, False)
            yield conv, n, "".join(parts), size, size, True

    started = False
    for key, role, text in rows:
        if started and key != conv:
            yield from close()
        if not started or key != conv:
            conv, parts, size, n, trailing, held, started = key, [], 0, 0, False, None, True
        if held is not None:
            yield (*held, False)
            held = None
        before, after = turn_marks(role)
        body = escape(text)
        parts.append(before + body + after)
        if role == "assistant":
            held = (conv, n, "".join(parts), size + len(before), size + len(before) + len(body))
            n += 1
            trailing = False
        else:
            trailing = True
        size += len(parts[-1])
    if started:
        yield from close()


EXAMPLES = "example int, formatted string, loss_start long, loss_end long, is_last boolean"


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_end, is_last: one row per assistant turn, and one for turns after the last of them.

    Positions are code points; loss_start equals loss_end where nothing is trainable. Null text and null role count as
    empty; null conv_id is a conversation of its own; rows that tie in turn are ordered by role, then text; repeated rows
    stay; an empty table gives no rows; other columns are left out. Rows of one conversation come together, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
        columns = [("conv_id", pa.int64()), ("example", pa.int32()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("is_last", pa.bool_())]
        whole = lambda held: pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, (_, kind) in zip(zip(*held), columns)], names=[c for c, _ in columns])
        held, chars = [], 0
        for row in expand_turns(rows):
            held.append(row)
            chars += len(row[2])
            if chars >= FLUSH_CHARS:
                yield whole(held)
                held, chars = [], 0
        if held:
            yield whole(held)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text_or_empty("role").alias("role"), text_or_empty().alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id long, {EXAMPLES}")


def read_back(examples: DataFrame) -> DataFrame:
    """A table of conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, from the examples alone, as they stream by. Without examples it has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, loss_chars, chars, n, out = hashlib.sha256(), 0, 0, 0, []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for conv, text, start, end, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "is_last"))):
                reply = unescape(text[start:end])
                loss.update(reply.encode())
                loss_chars, chars, n = loss_chars + len(reply), chars + len(text), n + 1
                if last:
                    turns = parse(text)
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    out.append((conv, len(turns), digest, loss_chars, loss.hexdigest(), chars, n))
                    loss, loss_chars, chars, n = hashlib.sha256(), 0, 0, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*out), kinds)], names=names)
                out = []

    with arrow_batches(examples.sparkSession):
        return written(examples.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"))

"""Chat formatting: conversations rendered by a compiled template, with marks for what an assistant generates.

Control strings in roles and texts are escaped reversibly: every backslash is doubled, and a backslash is put before
``<turn``, ``</turn`` and each sign of ``###``. An unescaped control string in the output therefore always is the template's own, and
``read`` recovers roles, texts and the loss mask's text.

Edge cases: null text and role count as empty; rows of a conversation come in order of turn (null first), then role,
then text, repeated rows each; a null conv_id is a conversation of its own; an empty table gives an empty result; further
columns are ignored. Memory is a few times the size of the conversation at hand, whatever is in its texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .templates import Template

TEMPLATE = """\
{%- for m in messages -%}
<turn {{ m.role | role }}>
{% if m.role == 'assistant' %}{{ '###' ~ ' ' ~ 'Assistant:' }}
{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>
{% endfor -%}
"""
LEAD = "### Assistant:\n"
#: Characters that are unescaped at a time.
PIECE = 1 << 16
CONTROL = {"\\": "\\\\", "<turn": "\\<turn", "</turn": "\\</turn", "###": "\\#\\#\\#"}
_ROLE = re.compile(r"[\\>\n]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLE_END = re.compile(r"\\.|[>\n]", re.S)
_TEXT_END = re.compile(r"\\.|</turn>\n", re.S)


def escape(text: str) -> str:
    """A text in which no control string stands unescaped."""
    for control, escaped in CONTROL.items():
        text = text.replace(control, escaped)
    return text


def escape_role(role: str) -> str:
    """A role in which nothing ends the turn's head."""
    return _ROLE.sub(r"\\\g<0>", role)


def unescape(text: str) -> str:
    """What was escaped; long texts are gone through in pieces, none of which ends within an escape."""
    if "\\" not in text:
        return text
    out, at = [], 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        run = end - at - len(text[at:end].rstrip("\\"))
        end += run % 2
        out.append(_ESCAPED.sub(r"\1", text[at:end]))
        at = end
    return "".join(out)


def compiled(source: str = TEMPLATE) -> Template:
    """A template that knows the filters ``escape`` and ``role``."""
    return Template(source, {"escape": escape, "role": escape_role})


@dataclass
class Read:
    """What a formatted conversation holds: turns as (role, text), and the texts under the loss mask."""

    turns: list[tuple[str, str]]
    loss: list[str]


def _until(end: re.Pattern, text: str, start: int, at: int) -> re.Match:
    """The first unescaped match of ``end``."""
    for m in end.finditer(text, at):
        if m[0][0] != "\\":
            return m
    raise ValueError(f"no turn at {start}")


def read(formatted: str, spans: list[tuple[int, int]]) -> Read:
    """Parses a formatted conversation; fails if it isn't whole turns."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith("<turn ", at):
            raise ValueError(f"no turn at {at}")
        head = _until(_ROLE_END, formatted, at, at + 6)
        if formatted[head.start() : head.end() + 1] != ">\n":
            raise ValueError(f"no turn at {at}")
        role, start = unescape(formatted[at + 6 : head.start()]), head.end() + 1
        if role == "assistant":
            if not formatted.startswith(LEAD, start):
                raise ValueError(f"no lead at {at}")
            start += len(LEAD)
        end = _until(_TEXT_END, formatted, at, start)
        turns.append((role, unescape(formatted[start : end.start()])))
        at = end.end()
    return Read(turns, [unescape(formatted[a:b]) for a, b in spans])


def format_conversations(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss_spans (start and end in code points) of every conversation.

    Rows are dealt by conversation and stream in order; only the conversation at hand is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, at, messages, done, size = compiled(source), None, [], [], 0

        def close() -> None:
            nonlocal size
            text, spans = template.render(messages=messages)
            done.append((at[0], text, [{"start": a, "end": b} for a, b in spans]))
            size += len(text)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["conv_id", "formatted", "loss_spans"],
            )

        for whole in batches:
            for b in common.slices(whole, "text"):
                for conv, role, text in zip(*(c.to_pylist() for c in b.columns)):
                    if at is not None and at[0] != conv:
                        close()
                        messages = []
                        if size > 1 << 22:
                            yield batch()
                            done, size = [], 0
                    at = (conv,)
                    messages.append({"role": role, "text": text})
        if at is not None:
            close()
        if done:
            yield batch()

    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, as counts and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for whole in batches:
            for b in common.slices(whole, "formatted"):
                out = []
                for conv, text, spans in zip(*(c.to_pylist() for c in b.columns)):
                    found = read(text, [(s["start"], s["end"]) for s in spans])
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    for r, t in found.turns:
                        turns.update(f"{r}\n".encode("utf-8", "surrogatepass"))
                        turns.update(t.encode("utf-8", "surrogatepass"))
                        turns.update(b"\n")
                    for t in found.loss:
                        loss.update(t.encode("utf-8", "surrogatepass"))
                    out.append((conv, len(found.turns), turns.hexdigest(), sum(map(len, found.loss)), loss.hexdigest(), len(text)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], [c.split()[0] for c in DIGESTS.split(", ")])

    return formatted.mapInArrow(run, DIGESTS)

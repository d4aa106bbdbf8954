"""Chat formatting: a finite-state machine over roles, and a declarative template.

Turns stream in order through the machine, which checks the turn order; each turn gives
three segments (header, text, end) with a loss flag.  Control strings inside texts are
escaped reversibly, so the formatted output can be read back without doubt.

A conversation is never gathered: its turns arrive sorted in one task and pass one at a
time, so memory does not grow with its length.  Time does: a conversation's digest is made in order, by one task.

Defined results: a null text is empty; a null role is the empty role; a role that the
template does not name is written by its hex digits and makes the conversation invalid; rows
with a null conv_id form one conversation; ties in turn are ordered by role and text; repeated rows
are turns each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import slices


@dataclass(frozen=True)
class Template:
    """What a formatted conversation looks like, and which orders of roles are valid."""

    head: str = "### "
    after_label: str = ": "
    end: str = "</turn>"
    after_end: str = "\n"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learned: frozenset = frozenset({"assistant"})
    start: str = "start"
    accepts: frozenset = frozenset({"answered"})
    moves: dict = field(default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})

    def controls(self) -> list[str]:
        return [self.head.strip(), self.end]

    def escape(self, text: str) -> str:
        r"""Doubles backslashes and writes the first character of a control string as \0, \1, ..."""
        marks = self.controls()
        pattern = "|".join([r"\\", *(f"({re.escape(c[0])})(?={re.escape(c[1:])})" for c in marks)])
        return re.sub(pattern, lambda m: "\\\\" if m.lastindex is None else f"\\{m.lastindex - 1}", text)

    def unescape(self, text: str) -> str:
        marks = self.controls()
        return re.sub(r"\\(.)", lambda m: "\\" if m[1] == "\\" else marks[int(m[1])][0], text, flags=re.S)

    def label(self, role: str) -> str:
        return self.labels.get(role) or "role-" + role.encode().hex()

    def role(self, label: str) -> str:
        if label.startswith("role-"):
            return bytes.fromhex(label[5:]).decode()
        return {v: k for k, v in self.labels.items()}[label]


_SEGMENT = [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("kind", pa.string()), ("segment", pa.string()), ("loss", pa.bool_()), ("state", pa.string()), ("valid", pa.bool_())]
_KINDS = ("head", "text", "end")
_SEGMENT_DDL = "conv_id long, turn_no long, kind string, segment string, loss boolean, state string, valid boolean"


def format_turns(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """The segments of all conversations, in order within a conversation.

    Columns: conv_id, turn_no (from 0), kind (head, text, end), segment, loss, state (after the
    turn), valid (no wrong turn so far; the last also says whether the conversation may end).
    """
    t = template or Template()
    spark = conversations.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    turns = turns.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        conv, no, state, valid = object(), 0, t.start, True
        for batch in slices(batches):
            out = [[] for _ in _SEGMENT]
            for c, _, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if c != conv:
                    conv, no, state, valid = c, 0, t.start, True
                after = t.moves.get((state, role))
                valid, state = valid and after is not None, after or "wrong"
                for kind, segment, loss in (("head", t.head + t.label(role) + t.after_label, False), ("text", t.escape(text), role in t.learned), ("end", t.end + t.after_end, False)):
                    for column, value in zip(out, (c, no, kind, segment, loss, state, valid)):
                        column.append(value)
                no += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, (_, k) in zip(out, _SEGMENT)], names=[n for n, _ in _SEGMENT])

    return turns.mapInArrow(run, _SEGMENT_DDL)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row a conversation, parsed from the formatted segments in format_turns' order; any other order is an error.

    Turns are found in the formatted text alone by the template's marks; the mask's text comes
    from the flagged segments.
    """
    t = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    close = t.end + t.after_end

    class Open:
        def __init__(self, conv):
            self.conv, self.left, self.turns, self.loss_chars, self.chars = conv, "", 0, 0, 0
            self.all, self.learned, self.valid, self.next = hashlib.sha256(), hashlib.sha256(), True, (0, 0)

        def add(self, turn_no, kind, segment, loss, state, valid):
            if (turn_no, kind) != (self.next[0], _KINDS[self.next[1]]):
                raise ValueError("segments are out of order: they stand by conversation, turn and kind, as format_turns gives them")
            self.next = (turn_no, self.next[1] + 1) if self.next[1] < 2 else (turn_no + 1, 0)
            self.chars += len(segment)
            self.valid = valid and state in t.accepts
            if loss:
                plain = t.unescape(segment)
                self.loss_chars += len(plain)
                self.learned.update(plain.encode("utf-8", "surrogatepass"))
            self.left += segment
            while (at := self.left.find(close)) >= 0:
                turn, self.left = self.left[:at], self.left[at + len(close) :]
                if not turn.startswith(t.head):
                    raise ValueError("formatted text does not begin with a turn's head")
                label, _, body = turn[len(t.head) :].partition(t.after_label)
                self.turns += 1
                self.all.update(f"{t.role(label)}\n{t.unescape(body)}\n".encode("utf-8", "surrogatepass"))

        def row(self):
            if self.left:
                raise ValueError("formatted text ends within a turn")
            return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, self.valid

    def run(batches):
        conv = None
        for batch in slices(batches, "segment"):
            rows = []
            for c, turn_no, kind, segment, loss, state, valid in zip(*(x.to_pylist() for x in batch.columns)):
                if conv is None or c != conv.conv:
                    rows += [conv.row()] if conv else []
                    conv = Open(c)
                conv.add(turn_no, kind, segment, loss, state, valid)
            yield batch_of(rows)
        yield batch_of([conv.row()] if conv else [])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names=names)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")

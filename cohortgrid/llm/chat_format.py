"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation, one production per turn:

    conversation := turn*
    turn         := "<s>" "[INST]" role "[/INST]" text "</s>"

The four control strings may stand nowhere else. A turn is rendered, parsed by
the deterministic parser below and compared with its source; while that fails,
control strings inside it get one more backslash ("<\\s>", "[\\/INST]"), and so do
those that already have some, so that reading takes exactly one away. Turns end
with a control string, so a conversation parses as its turns do.

Scale: rendering and the round trip are per turn, before any shuffle. Reading a
conversation back needs its turns in order: one shuffle by conversation, sorted
by Spark, then a stream that holds one turn and two hash states. A conversation
with a third of all rows is read by one task, as its digest is one sequential
hash, but never held in memory.

Cases: null role or text counts as empty; a null id is a conversation of its
own; turns that tie are ordered by role, then text, nulls first; repeated rows
are repeated turns; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control strings.
BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"

CONTROL = re.compile(r"</?s>|\[/?INST\]")
#: A control string with any number of backslashes behind its first character.
ESCAPABLE = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]))")
ESCAPED = re.compile(r"([<\[])\\(?=\\*/?(?:s>|INST\]))")


def escape(text: str) -> str:
    return ESCAPABLE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """(role, text) of each turn, or None if it isn't in the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(BOS + OPEN, at):
            return None
        fields, at = [], at + len(BOS + OPEN)
        for end in (CLOSE, EOS):
            m = CONTROL.search(formatted, at)
            if m is None or m.group() != end:
                return None
            fields.append(unescape(formatted[at : m.start()]))
            at = m.end()
        turns.append(tuple(fields))
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends in it (code points)."""
    r, t = role, text
    for _ in range(3):
        out = f"{BOS}{OPEN}{r}{CLOSE}{t}{EOS}"
        if parse(out) == [(role, text)]:
            start = len(BOS + OPEN + CLOSE) + len(r)
            return out, start, start + len(t)
        r, t = escape(r), escape(t)
    raise ValueError(f"a turn can't be formatted: {role[:40]!r}, {text[:80]!r}")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = []
        for role, text in zip(b.column(2), b.column(3), strict=True):  # one turn in memory at a time, beside the output
            out, *mask = render(role.as_py() or "", text.as_py() or "")
            made.append((out, *(mask if role.as_py() == "assistant" else (None, None))))
        cols = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], ["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_end"])


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per turn: conv_id, turn, role, text, formatted (a conversation's output is these, joined in order), loss_start and loss_end (of what is trained on; null for other roles)."""
    kinds = dict(turns.dtypes)
    return turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).mapInArrow(
        _render, f"conv_id {kinds[conv_col]}, turn {kinds[turn_col]}, role string, text string, formatted string, loss_start int, loss_end int"
    )


class _Reader:
    """Reads one conversation's formatted turns back: turns by the grammar, what is trained on under the loss mask."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def feed(self, formatted: str, start: int | None, end: int | None) -> None:
        found = parse(formatted)
        if found is None:
            raise ValueError(f"a formatted turn isn't in the grammar: {formatted[:120]!r}")
        for role, text in found:
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        if start is not None:
            text = unescape(formatted[start:end])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, now, reader, done = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], None, None, []
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    kind = pa.int64()

    def out() -> pa.RecordBatch:
        cols = [pa.array([d[0] for d in done], kind), *[pa.array([d[k + 1] for d in done], t) for k, t in enumerate(kinds)]]
        done.clear()
        return pa.RecordBatch.from_arrays(cols, names)

    for b in batches:
        kind = b.schema.field(0).type
        for conv, formatted, *mask in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if reader is None or conv != now:
                if reader is not None:
                    done.append((now, *reader.row()))
                now, reader = conv, _Reader()
            reader.feed(formatted.as_py(), *mask)
        if len(done) >= 2000:
            yield out()
    if reader is not None:
        done.append((now, *reader.row()))
    if done:
        yield out()


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted turns and their loss mask alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A turn outside the grammar stops the run."""
    kind = dict(formatted.dtypes)["conv_id"]
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_end")
    return ordered.mapInArrow(_read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

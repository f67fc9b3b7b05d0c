"""Chat formatting with a grammar round trip (operator 5).

Template (text is any turn's text)::

    conversation := "<s>" turn*
    system turn    := "<<SYS>>" text "<</SYS>>"
    user turn      := "[INST] " text " [/INST]"
    assistant turn := text "</s>"
    other turn     := "<<ROLE " role ">>" text "<</ROLE>>"

A backslash makes the next character plain. The parser below reads this grammar
from left to right without going back. Each turn is rendered plainly first and
parsed again; if the parser does not give back exactly the role and text (the
text holds control strings, backslashes, or runs into its closing mark), the
turn is rendered at the next level of escaping, until source and parse are
identical: first control strings and backslashes, then every character that is
no letter or digit. The loss mask covers the assistants' texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

# FIXED VALUES: the template's control strings.
BEGIN = "<s>"
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")}
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "<<ROLE ", ">>", "<</ROLE>>"
CONTROL = re.compile(r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE |<</ROLE>>|>>")
SPECIAL = re.compile(r"\\.|<s>|</s>|\[INST\] ?| ?\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE |<</ROLE>>|>>", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)

ESCAPES = (
    lambda text: text,
    lambda text: CONTROL.sub(lambda m: "\\" + m[0] if m[0] != "\\" else "\\\\", text),
    lambda text: re.sub(r"([\W_])", r"\\\1", text),
)


class GrammarError(ValueError):
    """Text that the grammar does not produce."""


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def _until(text: str, at: int, close: str) -> int:
    """Start of the closing mark; any other control string before it is an error."""
    while m := SPECIAL.search(text, at):
        if m[0][0] == "\\":
            at = m.end()
        elif m[0] == close:
            return m.start()
        elif m[0] == ">>":  # only closes a role's name
            at = m.end()
        else:
            break
    raise GrammarError(f"no {close!r}")


def parse_turns(text: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns from ``at`` on; start and end bound the escaped text."""
    while at < len(text):
        role = next((r for r, (mark, _) in MARKS.items() if mark and text.startswith(mark, at)), None)
        if role:
            start, close = at + len(MARKS[role][0]), MARKS[role][1]
        elif text.startswith(OTHER_OPEN, at):
            name_end = _until(text, at + len(OTHER_OPEN), OTHER_MID)
            role, start, close = unescape(text[at + len(OTHER_OPEN):name_end]), name_end + len(OTHER_MID), OTHER_CLOSE
        else:
            role, start, close = "assistant", at, MARKS["assistant"][1]
        end = _until(text, start, close)
        yield role, unescape(text[start:end]), start, end
        at = end + len(close)


def render_turn(role: str, text: str) -> tuple[str, int, int, int]:
    """(rendered turn, start and end of its text inside, level of escaping) such that it parses back."""
    for level, escape in enumerate(ESCAPES):
        opening, closing = MARKS.get(role) or (OTHER_OPEN + ESCAPES[max(level, 1)](role) + OTHER_MID, OTHER_CLOSE)
        turn = opening + escape(text) + closing
        try:
            back = list(parse_turns(turn))
        except GrammarError:
            continue
        if [b[:2] for b in back] == [(role, text)]:
            return turn, len(opening), len(turn) - len(closing), level
    raise GrammarError(f"turn of role {role!r} does not parse back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, text_start, text_end, trained, level) for every row of ``conversations``.

    A conversation's text is "<s>" and its segments in the order of
    (turn, segment); equal turn numbers are put in the order of their segments.
    text_start and text_end (code points) bound the text in its segment;
    ``trained`` marks assistant turns, whose text is the loss mask. One row in,
    one row out, without a shuffle: a conversation of any size is formatted by
    many tasks.

    A null text or role is empty; repeated rows are turns of their own; null
    conversation ids and null turns are kept (null turns come first). An empty
    table gives an empty result; other columns are ignored.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("text_start", pa.int64()),
                        ("text_end", pa.int64()), ("trained", pa.bool_()), ("level", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            rows = [render_turn(r, t or "") for r, t in zip(roles, batch.column("text").to_pylist())]
            if rows:
                segment, start, end, level = zip(*rows)
                columns = [batch.column("conv_id"), batch.column("turn"), segment, start, end, [r == "assistant" for r in roles], level]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(run), "conv_id long, turn long, segment string, text_start long, text_end long, trained boolean, level int")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) parsed from ``format_turns``' rows.

    Each conversation is streamed in order through the parser and two running
    digests, so one of any length needs no more memory than a segment.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for conv, segment, start, end, trained in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "segment", "text_start", "text_end", "trained"))):
                if state is None or conv != name:
                    if state:
                        done.append(finish(name, state))
                    name, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), len(BEGIN)]
                for role, text, *_ in parse_turns(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if trained:
                    loss = unescape(segment[start:end])
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
            if done:
                yield rows(done)
        if state:
            yield rows([finish(name, state)])

    def finish(name, state):
        return name, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def rows(done) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    ordered = formatted.select("conv_id", "turn", "segment", "text_start", "text_end", "trained").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "turn", "segment", "trained").mapInArrow(
        lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

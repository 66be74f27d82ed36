"""Operator 2, chat formatting with a grammar round trip.

A turn's text stands between an opening and a closing marker. The rendered turn is parsed again by a deterministic
parser; only if the turn comes back identical, and no control string stands in it but those of the template, is it taken.
Otherwise it is rendered again with more escaped: first nothing, then control strings (with backslashes doubled), then
every character that can begin one. A backslash stands for the character after it, so any level reads back by one rule.
Turns that each read back alone read back one after the other, since the parser takes the first closing marker; so
turns are formatted where they lie (``format_turn_rows``), and a conversation's text is that of its turns in order.

``read_back_turns`` streams the formatted turns in order and holds one of them, however long a conversation is.
``format_chat`` makes one row of each conversation, at one level for all its turns: that row, and what it is made from, is
held by one task.

Edge cases: a null text or role is an empty one; rows with the same turn are ordered by role, then text; rows with a
null turn come first; rows with a null conv_id form one conversation; repeated rows are turns of their own; an empty
table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values, the template's markers by role; any other role r is [TURN:r] ... [/TURN] with r percent-encoded.
MARKERS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[BOT]", "</s>")}
OTHER_OPEN, OTHER_CLOSE = "[TURN:{}]", "[/TURN]"
TRAINED_ROLE = "assistant"

CONTROL = re.compile(r"\[/?(?:SYS|INST|BOT|TURN)\]|\[TURN:[\w.~%-]*\]|</?s>")
OPEN = re.compile(r"\[(?:(SYS|INST|BOT)|TURN:([\w.~%-]*))\] ")
ROLE_OF = {opening[1:-1]: (role, f" {closing}") for role, (opening, closing) in MARKERS.items()}
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LEVELS = 3

TURNS = "conv_id long, turn long, role string, text string, formatted string, level int, loss_start long, loss_length long"
FORMATTED = "conv_id long, formatted string, level int, n_turns long, loss_spans array<struct<start:long,length:long>>"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    text = text.replace("\\", "\\\\")
    if level == 1:
        return CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)
    return re.sub(r"([\[<])(?=[^\\])", r"\1\\", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def markers(role: str) -> tuple[str, str]:
    return MARKERS.get(role) or (OTHER_OPEN.format(quote(role, safe="")), OTHER_CLOSE)


def render(turns: Iterable[tuple[str, str]], level: int) -> tuple[str, list[tuple[int, int]]]:
    """The text, and (start, length) of each trained turn's escaped content in it, in code points."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        opening, closing = markers(role)
        body = escape(text, level)
        if role == TRAINED_ROLE:
            spans.append((at + len(opening) + 1, len(body)))
        parts.append(f"{opening} {body} {closing}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(text: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered text; None if it isn't one."""
    turns, at = [], 0
    while at < len(text):
        opening = OPEN.match(text, at)
        if not opening:
            return None
        role, closing = ROLE_OF[opening[1]] if opening[1] else (unquote(opening[2]), f" {OTHER_CLOSE}")
        end = text.find(f"{closing}\n", opening.end())
        if end < 0:
            return None
        turns.append((role, unescape(text[opening.end() : end])))
        at = end + len(closing) + 1
    return turns


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, int, list[tuple[int, int]]]:
    """(text, level, spans) at the first level of escaping that reads back as ``turns``."""
    own = 2 * len(turns)
    for level in range(LEVELS):
        text, spans = render(turns, level)
        if len(CONTROL.findall(text)) == own and parse(text) == turns:
            return text, level, spans
    raise ValueError("a rendered conversation doesn't read back")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Whole conversations from rows sorted by conv_id."""
    current, turns = None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns and conv != current:
                yield current, turns
                turns = []
            current = conv
            turns.append((role or "", text or ""))
    if turns:
        yield current, turns


def _batches(rows: Iterable[dict], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of about ``most`` characters of formatted text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("formatted") or "") + 200
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_turn_rows(conversations: DataFrame) -> DataFrame:
    """One row for each turn, as of ``TURNS``: its text as it is, by which turns of one place are ordered; its text between
    markers; and where in that its trained text stands (null: nowhere)."""
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("formatted", pa.string()), ("level", pa.int32()), ("loss_start", pa.int64()), ("loss_length", pa.int64())])

    def rows(batches):
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                formatted, level, spans = format_turns([(role or "", text or "")])
                start, length = spans[0] if spans else (None, None)
                yield {"conv_id": conv, "turn": turn, "role": role or "", "text": text or "", "formatted": formatted, "level": level, "loss_start": start, "loss_length": length}

    return _turns(conversations).mapInArrow(lambda batches: _batches(rows(batches), schema), TURNS)


def _turns(conversations: DataFrame) -> DataFrame:
    c = F.col
    said = (F.coalesce(c(name).cast("string"), F.lit("")).alias(name) for name in ("role", "text"))
    return conversations.select(c("conv_id").cast("bigint"), c("turn").cast("bigint"), *said)


def read_back_turns(turns: DataFrame) -> DataFrame:
    """Digests of what each conversation's formatted turns hold, from a parse of them in order: the columns of ``READ_BACK``."""

    class Digest:
        def __init__(self, conv: int | None):
            self.conv, self.n_turns, self.loss_chars, self.chars = conv, 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, text: str, start: int | None, length: int | None) -> None:
            self.chars += len(text)
            for role, said in parse(text):
                self.n_turns += 1
                self.turns.update(f"{role}\n{said}\n".encode())
            if start is not None:
                loss = unescape(text[start : start + length])
                self.loss_chars += len(loss)
                self.loss.update(loss.encode())

        def row(self) -> dict:
            return {"conv_id": self.conv, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}

    def rows(batches):
        current = None
        for batch in batches:
            for conv, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length")), strict=True):
                if current is None or conv != current.conv:
                    if current is not None:
                        yield current.row()
                    current = Digest(conv)
                current.add(*turn)
        if current is not None:
            yield current.row()

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    given = dealt.select("conv_id", "formatted", "loss_start", "loss_length")
    return given.mapInArrow(lambda batches: _batches(rows(batches), DIGESTS), READ_BACK)


def format_chat(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, level, n_turns, loss_spans."""
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("level", pa.int32()), ("n_turns", pa.int64()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])

    def rows(batches):
        for conv, turns in _conversations(batches):
            text, level, spans = format_turns(turns)
            yield {"conv_id": conv, "formatted": text, "level": level, "n_turns": len(turns), "loss_spans": [{"start": a, "length": n} for a, n in spans]}

    dealt = _turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(lambda batches: _batches(rows(batches), schema), FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts hold, from a parse of them: the columns of ``READ_BACK``."""
    def rows(batches):
        for batch in batches:
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                turns = parse(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans)
                yield {
                    "conv_id": conv,
                    "n_turns": len(turns),
                    "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(),
                    "loss_chars": len(loss),
                    "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
                    "formatted_chars": len(text),
                }

    return formatted.mapInArrow(lambda batches: _batches(rows(batches), DIGESTS), READ_BACK)

"""Chat formatting: the turns of a conversation become one text with marked turns, and are read back from it.

The grammar is deterministic: a control string decides what follows it, and a text holds none.

    conversation  <s> turn*
    turn          [INST] text [/INST]             user
                  [ANS] text </s>                 assistant
                  <<SYS>> text <</SYS>>           system
                  [ROLE]name[/ROLE] text </s>     any other role

A turn is rendered as it is, the rendering is parsed, and what comes back is compared with the source. A turn that does
not come back (its text holds a control string, or what unescaping would change) is escaped: every control string in it,
written with any number of backslashes after its first character, gets one backslash more, which the parser takes off
again. The comparison is repeated until the texts are identical; if escaping is not enough, that is an error.

The loss mask is the spans of assistants' texts. A conversation is written in parts of about PART_CHARS characters, cut
between turns, and all work streams over sorted turns, so a conversation of any length takes a part's memory (one turn,
if longer). It is one text all the same, whose turns are written in order by one task.

Null text and null role count as empty, a null turn comes first, a null conv_id is a conversation of its own. Turns that
share a number are in the order of role, then text; repeated rows are turns of their own. An empty table gives an empty
table. Only the four columns are read, so that others cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
BEGIN, NAME_END = "<s>", "[/ROLE]"
#: How a role's turn begins and ends.
FRAMES = {"user": ("[INST] ", " [/INST]"), "assistant": ("[ANS] ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE]", " </s>")
PART_CHARS = 1 << 20
#: A control string with any number of backslashes after its first character.
STUFFED = "|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROL)

_control = re.compile("|".join(map(re.escape, CONTROL)))
_stuffed = re.compile(f"(?:{STUFFED})")
_opened = {opening.strip(): (role, opening, closing) for role, (opening, closing) in FRAMES.items()}


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _stuffed.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _stuffed.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def render(role: str, text: str, escaped: bool) -> tuple[str, int, int]:
    """A turn, and where its text begins and how long it is."""
    if escaped:
        role, text = (role if role in FRAMES else escape(role)), escape(text)
    opening, closing = FRAMES.get(role) or (f"{OTHER[0]}{role}{NAME_END} ", OTHER[1])
    return opening + text + closing, len(opening), len(text)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """role, text (unescaped), and the span of the text, turn by turn."""
    controls = _control.finditer(formatted)
    at = 0

    def upto(wanted: str, lead: str, tail: str) -> tuple[int, int]:
        """The text between here and the next control string, which has to be the wanted one, without the spaces that belong to the frame."""
        nonlocal at
        found = next(controls, None)
        if found is None or found[0] != wanted:
            raise GrammarError(f"{wanted} expected after {at}")
        start, end = at + len(lead), found.start() - len(tail)
        if end < start or formatted[at:start] != lead or formatted[end : found.start()] != tail:
            raise GrammarError(f"no frame at {at}")
        at = found.end()
        return start, end

    for opened in controls:
        if opened.start() != at:
            raise GrammarError(f"text outside of a turn at {at}")
        at = opened.end()
        if opened[0] == BEGIN and opened.start() == 0:
            continue
        if opened[0] == OTHER[0]:
            start, end = upto(NAME_END, "", "")
            role, closing = unescape(formatted[start:end]), OTHER[1]
            if role in FRAMES:
                raise GrammarError(f"{role} has a frame of its own")
        elif opened[0] in _opened:
            role, _, closing = _opened[opened[0]]
        else:
            raise GrammarError(f"{opened[0]} begins no turn")
        start, end = upto(closing.lstrip(" "), " ", " ")
        yield role, unescape(formatted[start:end]), start, end
    if at != len(formatted):
        raise GrammarError(f"text outside of a turn at {at}")


def _comes_back(formatted: str, turns: list[tuple[str, str]]) -> bool:
    try:
        return [(role, text) for role, text, _, _ in parse(formatted)] == turns
    except GrammarError:
        return False


def format_turns(turns: list[tuple[str, str]], begin: bool = True) -> tuple[str, list[tuple[int, int]]]:
    """The text of turns (role, text), and the spans of assistants' texts in it. Escapes only what would not come back."""
    lead = BEGIN if begin else ""
    rendered = [render(role, text, False) for role, text in turns]
    whole = lead + "".join(r[0] for r in rendered)
    if not _comes_back(whole, turns):
        rendered = [r if _comes_back(r[0], [t]) else render(*t, True) for r, t in zip(rendered, turns)]
        whole = lead + "".join(r[0] for r in rendered)
        if not _comes_back(whole, turns):
            raise GrammarError("escaped turns do not come back as they were")
    spans, at = [], len(lead)
    for (text, start, size), (role, _) in zip(rendered, turns):
        if role == "assistant":
            spans.append((at + start, size))
        at += len(text)
    return whole, spans


def _ordered(turns: DataFrame) -> DataFrame:
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part (from 0), formatted and loss (spans of start and length, in characters of the part), from turns (conv_id, turn, role, text).

    A conversation's parts, put together in order, are its text. They come in order, from one task.
    """
    small_batches(turns.sparkSession)
    rows = _ordered(turns)
    key = rows.schema["conv_id"]
    schema = T.StructType([key, *T.StructType.fromDDL("part int, formatted string, loss array<struct<start: int, length: int>>").fields])
    spans = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, none = None, object()
        now, part, held, chars, done = none, 0, [], 0, []

        def close() -> None:
            nonlocal part, held, chars
            if held:
                done.append((now, part, *format_turns(held, part == 0)))
                part, held, chars = part + 1, [], 0

        def give() -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * 4
            losses = [[{"start": a, "length": n} for a, n in loss] for loss in columns[3]]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(losses, spans)], names=schema.names)

        for batch in batches:
            kind, ready = batch.column("conv_id").type, sum(len(d[2]) for d in done)
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != now or now is none:
                    close()
                    now, part = conv, 0
                elif chars >= part_chars:
                    close()
                held.append((role, text))
                chars += len(text)
            if ready + sum(len(d[2]) for d in done) >= part_chars:
                yield give()
        close()
        if done:
            yield give()

    return rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turn (its place, from 0), role, text and loss (whether the mask has it), from a table of format_conversations in any order."""
    return _read(formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part"), _Turns)


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars, loss_sha256 and formatted_chars, read from
    what format_conversations gives, whose parts come in order."""
    return _read(formatted, _Digest)


class _Turns:
    SCHEMA = "turn long, role string, text string, loss boolean"

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.turns = 0

    def take(self, formatted: str, turns: list[tuple], loss: set[tuple[int, int]]) -> None:
        for role, text, start, end in turns:
            self.rows.append((self.turns, role, text, (start, end - start) in loss))
            self.turns += 1

    def ready(self, last: bool) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


class _Digest:
    SCHEMA = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def __init__(self) -> None:
        self.turns, self.lost, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def take(self, formatted: str, turns: list[tuple], loss: set[tuple[int, int]]) -> None:
        self.n, self.chars = self.n + len(turns), self.chars + len(formatted)
        for role, text, _, _ in turns:
            self.turns.update(f"{role}\n{text}\n".encode())
        for start, length in sorted(loss):
            text = unescape(formatted[start : start + length])
            self.loss_chars += len(text)
            self.lost.update(text.encode())

    def ready(self, last: bool) -> list[tuple]:
        return [(self.n, self.turns.hexdigest(), self.loss_chars, self.lost.hexdigest(), self.chars)] if last else []


def _read(formatted: DataFrame, reader: type) -> DataFrame:
    """Parse the parts of each conversation, which follow one another, with one reader a conversation."""
    small_batches(formatted.sparkSession)
    key = formatted.schema["conv_id"]
    schema = T.StructType([key, *T.StructType.fromDDL(reader.SCHEMA).fields])
    types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split(" ")[1]] for f in reader.SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, now, kind = None, None, None
        for batch in batches:
            kind, out = batch.column("conv_id").type, []
            for conv, part, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss"))):
                if part == 0:
                    out += [(now, *r) for r in (own.ready(True) if own else ())]
                    own, now = reader(), conv
                own.take(text, list(parse(text)), {(s["start"], s["length"]) for s in loss})
                out += [(now, *r) for r in own.ready(False)]
            yield _batch(out, kind)
        if own:
            yield _batch([(now, *r) for r in own.ready(True)], kind)

    def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(schema.names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, *types))], names=schema.names)

    return formatted.select("conv_id", "part", "formatted", "loss").mapInArrow(run, schema)

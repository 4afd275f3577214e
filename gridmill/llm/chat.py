"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  It is
never looked into: each turn is found by rendering the turns up to it and
comparing the result with the rendering before.  Where the longer output does not
begin with the shorter one, the template has rewritten history, and the turn is
marked as such.  The text inside a turn is found the same way, from renderings
with an empty text in its place.

Every prefix is rendered whole, so a conversation of n turns takes 3 n renderings of
up to n turns and is held in memory.  A template that is said to look back at no
more than ``Template.context`` turns is rendered over those alone, which takes time
in proportion to n; the claim is not trusted: what such a conversation comes to is
compared with one rendering of all its turns, and where they differ every prefix is
rendered whole after all.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

# Fixed values of the format: the control strings, and what they become inside a text.
BEGIN, CLOSE = "<|turn|>", "<|end|>\n"
_ESCAPES = (("\\", "\\\\"), ("<|", "<\\|"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """``text`` with a backslash before every backslash and inside every control string."""
    for plain, safe in _ESCAPES:
        text = text.replace(plain, safe)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unrole(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[Turn]) -> str:
    """The house template: a mark, the role, a line break, the text, a closing mark."""
    return "".join([f"{BEGIN}{_role(role)}\n{escape(text)}{CLOSE}" for role, text in turns])


def parse(piece: str) -> Turn:
    """(role, text) of one turn of the house template."""
    if not (piece.startswith(BEGIN) and piece.endswith(CLOSE)):
        raise ValueError("not a turn")
    head, _, body = piece[len(BEGIN) : -len(CLOSE)].partition("\n")
    return _unrole(head), unescape(body)


@dataclass(frozen=True)
class Template:
    render: Callable[[list[Turn]], str] = render
    context: int | None = None


HOUSE = Template()
#: Rows of an outgoing batch, about.
_ROWS = 5_000
#: Two texts (characters of private use) whose renderings show where a turn's own marks end and begin.
_PROBES = ("\ue000", "\ue001")


@dataclass
class Piece:
    text: str
    content_begin: int
    content_end: int
    rewrites: bool
    placed: bool


class Incremental:
    """Renders one conversation turn by turn, over ``template.context`` turns before each where that is given."""

    def __init__(self, template: Template = HOUSE) -> None:
        self.template = template
        self.window: deque[Turn] = deque(maxlen=template.context)
        self.before = self.opening = template.render([])
        self.whole = template.context is None

    def add(self, turn: Turn) -> Piece:
        show = self.template.render
        past = list(self.window)
        before = self.before if self.whole else show(past)
        after = show([*past, turn])
        rewrites = not after.startswith(before)
        common = len(commonprefix((before, after))) if rewrites else len(before)
        piece = after[common:]
        # the marks around the text are what renderings with two other texts share
        one, two = (show([*past, (turn[0], p)])[common:] for p in _PROBES)
        head = len(commonprefix((one, two)))
        tail = len(commonprefix((one[head:][::-1], two[head:][::-1])))
        # a template that does not show a text as it is has no span for it
        placed = one != two and head + tail <= len(piece)
        begin, end = (head, len(piece) - tail) if placed else (0, 0)
        self.window.append(turn)
        if self.whole:
            self.before = after
        return Piece(piece, begin, end, rewrites, placed)


def rendered(turns: list[Turn], template: Template = HOUSE) -> list[Piece]:
    """The pieces of a conversation; a bound on what the template looks back at is checked against the whole rendering."""
    held = Incremental(template)
    pieces = [held.add(t) for t in turns]
    if template.context is None or (not any(p.rewrites for p in pieces) and held.opening + "".join([p.text for p in pieces]) == template.render(turns)):
        return pieces
    return rendered(turns, Template(template.render))


PIECES = "conv_id long, turn_index long, role string, piece string, begin long, end long, loss_begin long, loss_end long, rewrites boolean, placed boolean"
_PIECE_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]


def _emit(rows, schema: str, types) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def format_turns(conversations: DataFrame, template: Template = HOUSE, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn, conversation after conversation and in turn order within partitions.

    ``piece`` is what the turn adds to the conversation's output (the output is
    the pieces in order); ``begin`` and ``end`` are its span there in characters;
    ``loss_begin`` and ``loss_end`` the span of a trained turn's text, else null;
    ``rewrites`` marks a turn whose rendering changed what came before; ``placed``
    is false where the template does not show the text in one place, which then has
    no span, so nothing but a text is ever trained on.

    Turns go by ``turn`` (null first), then role, then text, so ties and repeated
    rows have one order; each row is a turn.  Null texts and roles count as
    empty; rows of a null ``conv_id`` are one conversation.
    """

    def rows_of(key, turns):
        at = 0
        for index, ((role, _), p) in enumerate(zip(turns, rendered(turns, template), strict=True)):
            loss = role in trained and p.placed
            yield key, index, role, p.text, at, at + len(p.text), at + p.content_begin if loss else None, at + p.content_end if loss else None, p.rewrites, p.placed
            at += len(p.text)

    def run(batches):
        turns, conv, rows = [], None, []
        for batch in batches:
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if turns and key != conv:
                    rows += rows_of(conv, turns)
                    turns = []
                    if len(rows) >= _ROWS:
                        yield _emit(rows, PIECES, _PIECE_TYPES)
                        rows = []
                conv = key
                turns.append((role, text))
        rows += rows_of(conv, turns)
        for i in range(0, len(rows), _ROWS):
            yield _emit(rows[i : i + _ROWS], PIECES, _PIECE_TYPES)

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, PIECES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long, n_unplaced long"
_DIGEST_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the output of ``format_turns`` in the house template.

    Streams over the rows as they come, so it must follow ``format_turns`` at once.
    """

    class State:
        def __init__(self, key):
            self.key, self.n, self.chars, self.size, self.rewrites, self.unplaced = key, 0, 0, 0, 0, 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def row(self):
            return self.key, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.size, self.rewrites, self.unplaced

    def run(batches):
        state = None
        for batch in batches:
            done = []
            for key, piece, begin, loss_begin, loss_end, rewrites, placed in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if state is None or key != state.key:
                    if state is not None:
                        done.append(state.row())
                    state = State(key)
                role, text = parse(piece)
                state.turns.update(f"{role}\n{text}\n".encode())
                state.n += 1
                state.size += len(piece)
                state.rewrites += rewrites
                state.unplaced += not placed
                if loss_begin is not None:
                    text = unescape(piece[loss_begin - begin : loss_end - begin])
                    state.chars += len(text)
                    state.loss.update(text.encode())
            if done:
                yield _emit(done, DIGESTS, _DIGEST_TYPES)
        if state is not None:
            yield _emit([state.row()], DIGESTS, _DIGEST_TYPES)

    return pieces.select("conv_id", "piece", "begin", "loss_begin", "loss_end", "rewrites", "placed").mapInArrow(run, DIGESTS)

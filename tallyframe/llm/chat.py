"""Chat formatting: typed content parts flattened into marked text with a loss mask, and the way back.

A row is a turn: conv_id, turn, role, and typed ``content`` parts or a plain ``text``. A visitor flattens the
parts in their order: text is escaped, an image, audio or document part becomes a placeholder, and its
reference, place and expanded number of tokens are recorded. Turns are marked by role::

    user       <s>[INST] ... [/INST]</s>          assistant   <s>...</s>
    system     <s>[SYS] ... [/SYS]</s>            others      <s>[ROLE]name[/ROLE]...</s>

A control string inside a text or a role's name gets a backslash behind its first character, one more than
it has there, so no escaped text holds one and unescaping takes exactly these away. Neighbouring text
parts are escaped as one. The loss mask covers the text of assistant turns.

Turns are in the order of conv_id, turn (nulls first), role and text. They are spread by ranges of that order, so
a conversation of any length is formatted by many tasks. A null role, text or content is empty, a null
part is left out, an unknown kind of part raises. Null conv_ids are one conversation. Repeated rows are
turns of their own. An empty table gives no rows.

``read_back`` parses the formatted turns and digests conversations: those within a range where they are, longer
ones from packed pieces of their streams, which one task reads in turn without holding them (a digest
is made in order).
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.store import exact

# The template's control strings.
BOS, EOS = "<s>", "</s>"
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("", "")}
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
LOSS_ROLE = "assistant"

# First characters of control strings, and what follows them; a rest holds no first character and no backslash.
_ANGLE, _SQUARE = r"/?s>", r"(?:/?INST|/?SYS|/?ROLE|IMAGE|AUDIO|DOCUMENT)\]"
_HELD = re.compile(rf"<(?=\\*{_ANGLE})|\[(?=\\*{_SQUARE})")
_ESCAPED = re.compile(rf"<\\(?=\\*{_ANGLE})|\[\\(?=\\*{_SQUARE})")
_PLACES = re.compile("|".join(map(re.escape, PLACEHOLDERS.values())))

PIECE_BYTES = 1 << 16
PARTS = "array<struct<type string, text string, ref string, width int, height int, seconds double, pages int>>"
TURNS = ("conv_id long, turn long, role string, range int, place long, formatted string, "
         "loss array<struct<start: long, end: long>>, "
         "attachments array<struct<kind: string, ref: string, start: long, end: long, tokens: long>>, tokens long")
STREAMS = ("conv_id long, range int, place long, sub int, done boolean, n_turns long, loss_chars long, "
           "formatted_chars long, turns binary, loss binary")
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _HELD.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


@dataclass(frozen=True)
class Expansion:
    """Tokens that an attachment takes in the model's sequence."""

    tile: int = 512
    tile_tokens: int = 256
    audio_rate: float = 25.0
    page_tokens: int = 768

    def image(self, part) -> int:
        """Tiles that cover the image; one if its size is not known."""
        across, down = (math.ceil((part.get(side) or self.tile) / self.tile) for side in ("width", "height"))
        return max(1, across) * max(1, down) * self.tile_tokens

    def audio(self, part) -> int:
        return max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def document(self, part) -> int:
        return max(1, part.get("pages") or 1) * self.page_tokens


@dataclass
class Flattener:
    """Visitor of the parts of one turn."""

    expansion: Expansion
    out: list[str] = field(default_factory=list)
    length: int = 0
    texts: list[str] = field(default_factory=list)             # neighbouring text parts
    spans: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def write(self, s: str):
        self.out.append(s)
        self.length += len(s)

    def visit(self, part: dict | None):
        if part is not None:
            visitor = getattr(self, f"visit_{part['type']}", None)
            if visitor is None:
                raise ValueError(f"unknown kind of content part: {part['type']!r}")
            visitor(part)

    def visit_text(self, part):
        self.texts.append(part["text"] or "")

    def visit_image(self, part):
        self._attach("image", part, self.expansion.image(part))

    def visit_audio(self, part):
        self._attach("audio", part, self.expansion.audio(part))

    def visit_document(self, part):
        self._attach("document", part, self.expansion.document(part))

    def end_of_text(self):
        if self.texts:
            start = self.length
            self.write(escape("".join(self.texts)))
            self.spans.append((start, self.length))
            self.texts = []

    def _attach(self, kind: str, part, tokens: int):
        self.end_of_text()
        start = self.length
        self.write(PLACEHOLDERS[kind])
        self.attachments.append({"kind": kind, "ref": part["ref"], "start": start, "end": self.length, "tokens": tokens})


def format_turn(role: str | None, parts: list, expansion: Expansion = Expansion()) -> Flattener:
    """A visitor that has written the turn; its spans are those of the text parts."""
    role = role or ""
    v = Flattener(expansion)
    opening, closing = MARKS.get(role, (ROLE + escape(role) + ROLE_END, ""))
    v.write(BOS + opening)
    for part in parts:
        v.visit(part)
    v.end_of_text()
    v.write(closing + EOS)
    return v


def parse(formatted: str) -> list[tuple[str, list[str]]]:
    """(role, texts and placeholders in their order) of each turn of a formatted conversation."""
    turns = []
    for turn in formatted.split(BOS)[1:]:
        if not turn.endswith(EOS):
            raise ValueError("a turn without its end")
        body, role = turn[:-len(EOS)], None
        for name, (opening, closing) in MARKS.items():
            if opening and body.startswith(opening):
                role, body = name, body[len(opening):len(body) - len(closing)]
                break
        if role is None and body.startswith(ROLE):
            name, body = body[len(ROLE):].split(ROLE_END, 1)
            role = unescape(name)
        held = [unescape(t) for t in _PLACES.split(body)]
        placed = _PLACES.findall(body)
        turns.append((LOSS_ROLE if role is None else role, [x for pair in zip(held, [*placed, ""], strict=True) for x in pair][:-1]))
    return turns


def _format_batches(expansion: Expansion):
    def run(batches):
        part_id, place = TaskContext.get().partitionId(), 0
        names = [f.split(" ", 1)[0] for f in ("conv_id", "turn", "role", "range", "place", "formatted", "loss", "attachments", "tokens")]
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        ref = pa.struct([("kind", pa.string()), ("ref", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.int64())])
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            roles = cols["role"].to_pylist()
            if "content" in cols:
                contents = cols["content"].to_pylist()
            else:
                contents = [[{"type": "text", "text": t}] for t in cols["text"].to_pylist()]
            done = [format_turn(r, c or [], expansion) for r, c in zip(roles, contents, strict=True)]
            loss = [[{"start": s, "end": e} for s, e in v.spans] if r == LOSS_ROLE else [] for r, v in zip(roles, done, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [cols["conv_id"], cols["turn"], cols["role"], pa.array([part_id] * len(done), pa.int32()),
                 pa.array(range(place, place + len(done)), pa.int64()), pa.array(["".join(v.out) for v in done], pa.string()),
                 pa.array(loss, pa.list_(span)), pa.array([v.attachments for v in done], pa.list_(ref)),
                 pa.array([sum(a["tokens"] for a in v.attachments) for v in done], pa.int64())], names=names)
            place += len(done)
    return run


def format_conversations(convs: DataFrame, expansion: Expansion = Expansion()) -> DataFrame:
    """One row per turn, in order: ``formatted``, the loss mask and attachments with places in it, their tokens.

    A conversation's text is its turns' ``formatted`` in the order of (range, place). The parts come
    from ``content`` (``PARTS``) where the table has it, else the text is one part.
    """
    typed = "content" in convs.columns
    body = "content" if typed else "text"
    rows = exact(convs, "conv_id", "turn", "role", body).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
        F.col(body).cast(PARTS if typed else "string"))
    # rows that tie in the hashes too are equal; their own number only spreads them
    rows = rows.withColumns({"tie": F.xxhash64("role", body), "own": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "tie", "own"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "own")
    return rows.mapInArrow(_format_batches(expansion), TURNS)


class _Streams:
    """The streams of one conversation in one task: digested at its end, or handed on in pieces."""

    def __init__(self, key, whole: bool):
        self.key, self.whole = key, whole       # whole: no other task can hold a part of it, unless it is open
        self.turns, self.loss = bytearray(), bytearray()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.sub, self.open = 0, False

    def add(self, formatted: str, loss: list):
        for role, parts in parse(formatted):
            self.turns += f"{role}\n{''.join(parts[::2])}\n".encode()
            self.n_turns += 1
        for span in loss:
            text = unescape(formatted[span["start"]:span["end"]])
            self.loss += text.encode()
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)

    def pieces(self, at, least: int = PIECE_BYTES):
        """Rows of pieces while more than ``least`` bytes are held."""
        while max(len(self.turns), len(self.loss)) > least:
            turns, loss = bytes(self.turns[:PIECE_BYTES]), bytes(self.loss[:PIECE_BYTES])
            del self.turns[:PIECE_BYTES], self.loss[:PIECE_BYTES]
            yield self._row(at, False, zlib.compress(turns, 1), zlib.compress(loss, 1))

    def end(self, at, whole: bool):
        if whole and self.whole and not self.sub:
            yield self._row(at, True, hashlib.sha256(self.turns).digest(), hashlib.sha256(self.loss).digest())
        else:
            yield from self.pieces(at, 0)
            if self.n_turns:                    # empty streams still count their turns
                yield self._row(at, False, zlib.compress(b""), zlib.compress(b""))

    def _row(self, at, done, turns, loss):
        row = (self.key, *at, self.sub, done, self.n_turns, self.loss_chars, self.formatted_chars, turns, loss)
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.sub += 1
        return row


def _rows_batch(rows: list, fields: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    named = [f.split() for f in fields.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, named, strict=True)],
                                      names=[n for n, _ in named])


def _stream_batches(batches):
    now, last, rows = None, (-1, -1), []
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv_id", "range", "place", "formatted", "loss")]
        for conv, part, place, formatted, loss in zip(*cols, strict=True):
            if (part, place) <= last:
                raise ValueError("turns must be read in the order of (range, place)")
            if now is None or now.key != conv:
                if now is not None:
                    rows += now.end(start, True)
                now, start = _Streams(conv, whole=now is not None), (part, place)
            last = part, place
            now.add(formatted, loss)
            rows += now.pieces(start)
            if len(rows) > 256:
                yield _rows_batch(rows, STREAMS)
                rows = []
    if now is not None:
        rows += now.end(start, False)
    yield _rows_batch(rows, STREAMS)


def _digest_batches(batches):
    key, counts, hashes, rows, begun = None, None, None, [], False

    def closed():
        return (key, counts[0], hashes[0].hexdigest(), counts[1], hashes[1].hexdigest(), counts[2])

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("conv_id", "done", "n_turns", "loss_chars", "formatted_chars", "turns", "loss")]
        for conv, done, n, loss_chars, chars, turns, loss in zip(*cols, strict=True):
            if done:
                rows.append((conv, n, turns.hex(), loss_chars, loss.hex(), chars))
                continue
            if not begun or conv != key:
                if begun:
                    rows.append(closed())
                key, counts, hashes, begun = conv, [0, 0, 0], [hashlib.sha256(), hashlib.sha256()], True
            counts = [a + c for a, c in zip(counts, (n, loss_chars, chars), strict=True)]
            for h, packed in zip(hashes, (turns, loss), strict=True):
                h.update(zlib.decompress(packed))
        yield _rows_batch(rows, DIGESTS)
        rows = []
    yield _rows_batch([closed()] if begun else [], DIGESTS)


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, parsed from ``formatted`` turns in their order: numbers and digests of its
    turns (role, line break, text, line break), of the text under the loss mask, and its length."""
    streams = turns.select("conv_id", "range", "place", "formatted", "loss").mapInArrow(_stream_batches, STREAMS)
    together = streams.repartition("conv_id").sortWithinPartitions("conv_id", "range", "place", "sub")
    return together.mapInArrow(_digest_batches, DIGESTS)

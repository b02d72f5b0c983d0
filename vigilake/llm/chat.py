"""Chat formatting with typed content parts (operator 8).

A message's content is a list of typed parts. A visitor turns parts into template text in order: text is
escaped, an image, audio or document part becomes a placeholder and an attachment record with the number of
tokens that it expands to. Turns are marked by control strings; inside texts, every opening control character is
doubled by an escape, so no text, whatever it says, can look like a mark, and parsing gives back exactly
what went in. The loss mask covers the assistants' texts and nothing else.

A conversation can be larger than memory: its rows are sorted by turn inside a partition and formatted as a
stream, piece by piece, with running digests. The order of turns makes a conversation a serial thing, so one
conversation is one task's stream, but no group is ever held. Hot first turns, roles or texts don't matter:
rows are dealt by conv_id only.

Defined results: a null text is empty, a null role is ""; rows of equal turn keep the order of role, then text;
rows with a null conv_id are one conversation; an empty table gives an empty one; further columns are ignored; parts that
aren't sound become what parts_of says.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.session import ship

#: The template's marks. ESCAPE before OPEN or ESCAPE inside a text makes it plain text.
OPEN, CLOSE, ESCAPE = "<|", "|>", "\\"
START, BODY, END = f"{OPEN}turn{CLOSE}", f"{OPEN}says{CLOSE}", f"{OPEN}done{CLOSE}"


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Image:
    ref: str
    width: int = 0
    height: int = 0


@dataclass(frozen=True)
class Audio:
    ref: str
    seconds: float = 0.0


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int = 0


Part = Text | Image | Audio | Document


@dataclass(frozen=True)
class Expansion:
    """Tokens that attachments stand for: a patch of an image, a second of audio, a page of a document."""

    patch: int = 14
    audio: float = 25.0
    page: int = 600


@dataclass(frozen=True)
class Attachment:
    kind: str
    ref: str
    tokens: int
    at: int  # code point of the placeholder in the formatted text


def escape(text: str) -> str:
    """Reversible: no unescaped OPEN is left in the result."""
    return text.replace(ESCAPE, ESCAPE * 2).replace("<", ESCAPE + "<")


_UNESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Visitor:
    """Flattens parts into placeholders and escaped text, in order, and records attachments."""

    def __init__(self, expansion: Expansion = Expansion()):
        self.expansion, self.attachments, self.size = expansion, [], 0

    def visit(self, part: Part) -> str:
        out = getattr(self, f"visit_{type(part).__name__.lower()}")(part)
        self.size += len(out)
        return out

    def visit_text(self, part: Text) -> str:
        return escape(part.text)

    def visit_image(self, part: Image) -> str:
        patch = self.expansion.patch
        return self._placeholder("image", part.ref, -(-part.width // patch) * -(-part.height // patch))

    def visit_audio(self, part: Audio) -> str:
        return self._placeholder("audio", part.ref, int(-(-part.seconds * self.expansion.audio // 1)))

    def visit_document(self, part: Document) -> str:
        return self._placeholder("document", part.ref, part.pages * self.expansion.page)

    def _placeholder(self, kind: str, ref: str, tokens: int) -> str:
        self.attachments.append(Attachment(kind, ref, tokens, self.size))
        return f"{OPEN}{kind}:{len(self.attachments) - 1}{CLOSE}"


#: What a part of each type is made of, besides its ref.
SIZES = {"image": (Image, {"width": int, "height": int}), "audio": (Audio, {"seconds": float}), "document": (Document, {"pages": int})}


def parts_of(content: object) -> list[Part]:
    """Parts from a plain string, or a list of dicts with "type" and the fields of that type.

    Fields of other types are ignored, a missing ref is empty, a size that is missing, negative or not finite is 0; a part
    of another type or of none is its text, empty without one; a null part is no part.
    """
    if content is None or isinstance(content, str):
        return [Text(content or "")]
    out: list[Part] = []
    for item in content:
        if item is None:
            continue
        values = dict(item)
        if (kind := values.get("type")) not in SIZES:
            out.append(Text(values.get("text") or ""))
            continue
        made, sizes = SIZES[kind]
        sound = lambda x: x is not None and math.isfinite(x) and x > 0
        out.append(made(values.get("ref") or "", **{k: f(values[k]) if sound(values.get(k)) else f(0) for k, f in sizes.items()}))
    return out


def header(role: str) -> str:
    return START + escape(role) + BODY


@dataclass
class Formatted:
    text: str = ""
    attachments: list[Attachment] = field(default_factory=list)
    loss: list[tuple[int, int]] = field(default_factory=list)  # code point spans under the loss mask

    @property
    def expanded_tokens(self) -> int:
        return sum(x.tokens for x in self.attachments)


def format_turns(turns: Sequence[tuple[str, object]], expansion: Expansion = Expansion()) -> Formatted:
    """Turns (role, content) as one text, its attachments and the spans of assistants' content."""
    visitor, out, spans = Visitor(expansion), [], []
    for role, content in turns:
        out.append(header(role))
        visitor.size += len(out[-1])
        begin = visitor.size
        out += [visitor.visit(part) for part in parts_of(content)]
        if role == "assistant":
            spans.append((begin, visitor.size))
        out.append(END)
        visitor.size += len(END)
    return Formatted("".join(out), visitor.attachments, spans)


_MARK = re.compile(r"(?:\\.|[^<\\])+|<\|([^|]*)\|>", re.S)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, unescaped content, begin, end) of each turn of a formatted text; placeholders stay as they are."""
    role, begin, state, pieces = "", 0, "", []
    for m in _MARK.finditer(text):
        mark = m[1]
        if mark == "turn":
            state, pieces = "role", []
        elif mark == "says":
            role, state, pieces, begin = unescape("".join(pieces)), "content", [], m.end()
        elif mark == "done":
            yield role, "".join(pieces), begin, m.start()
            state, pieces = "", []
        else:
            pieces.append(m[0] if mark is not None or state == "role" else unescape(m[0]))


def loss_text(text: str, spans: Sequence[tuple[int, int]]) -> str:
    return "".join(unescape(text[a:b]) for a, b in spans)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", limit: int = 1 << 26) -> DataFrame:
    """conv_col, part, formatted, loss (array of begin, end), attachments (JSON) of whole conversations.

    content_col holds texts, or JSON lists of typed parts if it is an array of structs. A conversation whose
    formatted text exceeds ``limit`` characters continues in a row with the next part number, cut between turns.
    """
    ship(turns.sparkSession)
    kind = turns.schema[conv_col].dataType.simpleString()
    src = _ordered(turns, conv_col, turn_col, role_col, content_col)

    def run(batches):
        now, part, held, size = None, 0, [], 0

        def row():
            done = format_turns(held)
            return [now, part, done.text, [[a, b] for a, b in done.loss], json.dumps([x.__dict__ for x in done.attachments])]

        def out(rows):
            arrays = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (id_type, pa.int32(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [conv_col, "part", "formatted", "loss", "attachments"])

        id_type, first = None, True
        for batch in batches:
            id_type, rows = batch.column(0).type, []
            for conv, role, content in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                more = len(content) if isinstance(content, str) else 1000
                if held and (conv != now or size + more > limit):
                    rows.append(row())
                    part, held, size = (part + 1 if conv == now else 0), [], 0
                elif first:
                    part = 0
                now, first = conv, False
                held.append((role or "", content))
                size += more
            if rows:
                yield out(rows)
        if held:
            yield out([row()])

    return src.mapInArrow(run, f"`{conv_col}` {kind}, part int, formatted string, loss array<array<long>>, attachments string")


def _ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, content_col: str) -> DataFrame:
    src = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.col(content_col).alias("content"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("content") if src.schema["content"].dataType.simpleString() == "string" else F.to_json(F.col("content"))
    return src.repartition(parts, "conv").sortWithinPartitions("conv", "turn", "role", text)


def digest_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Format each conversation as a stream, read the formatted turns back and digest what was read.

    Columns: conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """
    ship(turns.sparkSession)
    kind = turns.schema[conv_col].dataType.simpleString()
    src = _ordered(turns, conv_col, turn_col, role_col, text_col)
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        now, open_, id_type = None, False, None
        n = chars = total = 0
        turn_hash = loss_hash = None
        for batch in batches:
            id_type, rows = batch.column(0).type, []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if not open_ or conv != now:
                    if open_:
                        rows.append((now, n, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), total))
                    now, open_, n, chars, total, turn_hash, loss_hash = conv, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                done = format_turns([(role, text)])
                for back, said, _, _ in parse(done.text):
                    n += 1
                    turn_hash.update(f"{back}\n{said}\n".encode("utf-8", "replace"))
                masked = loss_text(done.text, done.loss)
                chars += len(masked)
                loss_hash.update(masked.encode("utf-8", "replace"))
                total += len(done.text)
            if rows:
                yield pack(rows, id_type)
        if open_:
            yield pack([(now, n, turn_hash.hexdigest(), chars, loss_hash.hexdigest(), total)], id_type)

    def pack(rows, id_type):
        kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return src.mapInArrow(run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

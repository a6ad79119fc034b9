"""Chat formatting of typed content parts.

A visitor flattens the parts of a message (text, image, audio, document) into one string: texts in place,
every attachment as a placeholder, with a record of its reference and of the tokens it expands to. A turn is

    <|turn|>role\\n ... <|end|>\\n

and the template's control strings all start with `<|`. Inside texts and roles, `<|` is written with one
backslash more between the two characters than it has (`<|` as `<\\|`, `<\\|` as `<\\\\|`, ...), which reading
takes away again: no text can forge a marker, and every text is restored exactly.

Turns are formatted one by one, so a conversation of any length needs no more memory than its longest turn;
reading back follows sorted rows in the same way.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

TURN, END = "<|turn|>", "<|end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_PIECE = re.compile(r"<\|turn\|>([^\n]*)\n(.*)<\|end\|>\n", re.S)
_PLACE = re.compile(r"<\|(image|audio|document):(\d+)\|>")
LEARNED = "assistant"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens an attachment expands to: a patch of an image, a second of audio, a page of a document.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass
class Flattened:
    """What a visitor has collected of one message."""

    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)
    tokens: int = 0


class PartVisitor:
    """Visits typed parts in order; count is the tokenizer of texts (words by default)."""

    def __init__(self, count: Callable[[str], int] = lambda text: len(text.split())) -> None:
        self.count = count

    def visit(self, parts: list[dict]) -> Flattened:
        out = Flattened()
        for part in parts:
            self.method(part)(part, out)
        return out

    def method(self, part: dict) -> Callable[[dict, Flattened], None]:
        """What visits a part: that of its type, or of texts where the type is null or unknown."""
        return getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_text)

    def visit_text(self, part: dict, out: Flattened) -> None:
        text = part.get("text") or ""
        out.pieces.append(escape(text))
        out.tokens += self.count(text)

    def _attach(self, kind: str, part: dict, tokens: int, out: Flattened) -> None:
        number = len(out.attachments)
        out.pieces.append(f"<|{kind}:{number}|>")
        out.attachments.append((number, kind, part.get("ref"), tokens))
        out.tokens += tokens

    def visit_image(self, part: dict, out: Flattened) -> None:
        self._attach("image", part, max(1, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH)), out)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * PER_SECOND)), out)

    def visit_document(self, part: dict, out: Flattened) -> None:
        self._attach("document", part, max(1, (part.get("pages") or 0) * PER_PAGE), out)


def format_turn(role: str | None, parts: list[dict], visitor: PartVisitor) -> tuple[str, int, int, Flattened]:
    """The turn's string, the span of it that is learned from (empty if not the assistant's), and what was flattened.

    Parts that meet and are visited as text (of type text, null or unknown) are escaped as one, so that no `<|`
    forms between them.
    """
    joined: list[dict] = []
    as_text = lambda part: visitor.method(part) == visitor.visit_text
    for part in parts:
        if as_text(part) and joined and as_text(joined[-1]):
            joined[-1] = {"type": "text", "text": (joined[-1].get("text") or "") + (part.get("text") or "")}
        else:
            joined.append(part)
    flat = visitor.visit(joined)
    body = "".join(flat.pieces)
    head = f"{TURN}{escape_role(role or '')}\n"
    learned = role == LEARNED
    return head + body + END + "\n", len(head) if learned else 0, len(head) + len(body) if learned else 0, flat


def read_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a formatted turn, unescaped; attachments stay as placeholders."""
    m = _PIECE.fullmatch(piece)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape_role(m[1]), unescape(m[2])


def formatted(turns: DataFrame, count: Callable[[str], int] | None = None) -> DataFrame:
    """turns(conv_id, turn, role, and text or parts, ...) -> conv_id, turn, ordinal key columns and the formatted turn.

    Returns conv_id, turn, role, text, piece, loss_start, loss_end (code points of the piece), attachments
    (number in the turn, kind, ref, tokens) and tokens. With a column `parts` (array of PART) the text is
    ignored; a part of an unknown or null type is a text. A null text or parts is an empty message, a null role an empty one; null ids and turns stay null.
    Rows that repeat are turns of their own; further columns are ignored; an empty table gives an empty result.
    A conversation is the concatenation of its pieces by turn (ties by role, then text; null turn first).
    """
    has_parts = "parts" in turns.columns
    content = F.col("parts").alias("parts") if has_parts else F.lit(None).cast("string").alias("parts")
    text = F.lit(None).cast("string").alias("text") if has_parts else F.col("text")
    rows = turns.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("string").alias("turn"), "role", text, content,
    )
    visitor = PartVisitor(count) if count else PartVisitor()

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for role, t, parts in zip(frame["role"], frame["text"], frame["parts"], strict=True):
                given = [{"type": "text", "text": t}] if not has_parts else [p if isinstance(p, dict) else p.asDict() for p in (parts if parts is not None else [])]
                piece, start, end, flat = format_turn(role, given, visitor)
                out.append((piece, start, end, [dict(zip(("number", "kind", "ref", "tokens"), a, strict=True)) for a in flat.attachments], flat.tokens))
            made = pd.DataFrame(out, columns=["piece", "loss_start", "loss_end", "attachments", "tokens"])
            yield pd.concat([frame[["conv", "turn", "role", "text"]].reset_index(drop=True), made], axis=1)

    schema = "conv string, turn string, role string, text string, piece string, loss_start int, loss_end int, attachments array<struct<number:int,kind:string,ref:string,tokens:long>>, tokens long"
    out = rows.mapInPandas(make, schema)
    return out.select(F.col("conv").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[c for c in out.columns if c not in ("conv", "turn")])


class _Reader:
    """Digests of one conversation, fed turn by turn from the formatted pieces."""

    def __init__(self, conv: str | None) -> None:
        self.conv, self.turns, self.chars, self.loss_chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int, end: int) -> None:
        role, text = read_turn(piece)
        self.turns += 1
        self.chars += len(piece)
        self.all.update(utf8(f"{role}\n{text}\n"))
        under = unescape(piece[start:end])
        self.loss_chars += len(under)
        self.loss.update(utf8(under))

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame) -> DataFrame:
    """formatted() -> conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the pieces."""
    keyed = pieces.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn", "role", "text", "piece", "loss_start", "loss_end")
    dealt = keyed.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn", "role", "text")
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = None
        for frame in batches:
            done = []
            for conv, piece, start, end in frame[["conv", "piece", "loss_start", "loss_end"]].itertuples(index=False):
                if reader is None or reader.conv != conv:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.add(piece, start, end)
            yield pd.DataFrame(done, columns=names)
        if reader is not None:
            yield pd.DataFrame([reader.row()], columns=names)

    out = dealt.mapInPandas(read, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.select(F.when(F.col("conv") != "", F.col("conv").cast("long")).alias("conv_id"), *names[1:])

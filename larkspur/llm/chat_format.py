"""Chat formatting: conversations as marked, escaped text with a loss mask.

A message's content is a string or typed parts (text, image, audio, document). A visitor flattens parts in
order: text as it is, every other part as a placeholder, recording an attachment reference and the number of
tokens that the placeholder stands for.

A turn is `<turn ROLE>`, a line feed, its text, `</turn>` and a line feed. Control strings in texts and roles
are escaped by a backslash, and so are backslashes, so that a reader gets every text back. Placeholders, such as
`<image 0>`, are control strings too: one that a text spells is escaped, so only attachments have them, and a
reader gets the parts back. The loss mask has the characters of assistants' texts, without placeholders.

Turns are formatted row by row; a conversation's digest is a fold over its turns in order that streams
through one task and keeps nothing of them, so its length is not bounded by memory.

Defined results: null text and null role are empty; rows of one turn number follow each other by role
(nulls first), then by their formatted text; a null turn comes first; a null conversation is one of its own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm._spark import lean, partitions, small_batches

# --- typed content -----------------------------------------------------------------------------------------


@dataclass
class Attachment:
    kind: str
    ref: str
    tokens: int


@dataclass
class Flattened:
    """parts: texts, and for each attachment its number; neighbouring texts are one."""

    parts: list[str | int] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)

    def add(self, text: str) -> None:
        if self.parts and isinstance(self.parts[-1], str):
            self.parts[-1] += text
        elif text:
            self.parts.append(text)

    def placeholder(self, k: int) -> str:
        return f"<{self.attachments[k].kind} {k}>"

    @property
    def text(self) -> str:
        """With placeholders as they stand, unescaped."""
        return "".join(x if isinstance(x, str) else self.placeholder(x) for x in self.parts)


class PartVisitor:
    """Flattens typed parts; what a placeholder expands to in tokens is a matter of its kind."""

    def __init__(self, patch: int = 28, audio_rate: float = 25.0, page_tokens: int = 512):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def visit(self, content: object) -> Flattened:
        out = Flattened()
        parts = content if isinstance(content, list) else [{"type": "text", "text": content}]
        for part in parts:
            part = part if isinstance(part, dict) else {"type": "text", "text": part}
            method = getattr(self, f"visit_{part.get('type', 'text')}", None)
            if method is None:
                raise ValueError(f"unknown content part {part.get('type')!r}")
            method(part, out)
        return out

    def visit_text(self, part: dict, out: Flattened) -> None:
        text = part.get("text")
        out.add("" if text is None else str(text))

    def _attach(self, kind: str, part: dict, tokens: int, out: Flattened) -> None:
        out.attachments.append(Attachment(kind, str(part.get("ref") or part.get("url") or ""), max(1, tokens)))
        out.parts.append(len(out.attachments) - 1)

    def visit_image(self, part: dict, out: Flattened) -> None:
        across, down = (-(-int(part.get(k) or self.patch) // self.patch) for k in ("width", "height"))
        self._attach("image", part, across * down, out)

    def visit_audio(self, part: dict, out: Flattened) -> None:
        self._attach("audio", part, round(float(part.get("seconds") or 0) * self.audio_rate), out)

    def visit_document(self, part: dict, out: Flattened) -> None:
        self._attach("document", part, int(part.get("pages") or 1) * self.page_tokens, out)


# --- the template -------------------------------------------------------------------------------------------

OPEN, CLOSE = "<turn ", "</turn>"
KINDS = ("image", "audio", "document")
_CONTROL = re.compile(rf"\\|<(?=turn |/turn>|(?:{'|'.join(KINDS)}) \d+>)|>(?=\n|\Z)|#(?=## )")
_PLACE = re.compile(rf"((?:\\.|[^\\<]|<(?!(?:{'|'.join(KINDS)}) \d+>))+)|<({'|'.join(KINDS)}) (\d+)>", re.S)
_TURN = re.compile(r"<turn ((?:\\.|[^\\])*?)>\n((?:\\.|[^\\])*?)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turn(role: str, text: str, trained: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The marked turn and the [start, end) characters of it that count for the loss."""
    return format_parts(role, Flattened([text]), trained)


def format_parts(role: str, flat: Flattened, trained: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]]]:
    """The same for flattened parts: texts are escaped, placeholders stand as they are and outside the loss."""
    out, spans = f"{OPEN}{escape(role)}>\n", []
    for part in flat.parts:
        piece = escape(part) if isinstance(part, str) else flat.placeholder(part)
        if isinstance(part, str):
            spans.append((len(out), len(out) + len(piece)))
        out += piece
    return f"{out}{CLOSE}\n", (spans or [(len(out), len(out))]) if role in trained else []


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back; a placeholder reads as it stands."""
    return [(role, "".join(x if isinstance(x, str) else f"<{x[0]} {x[1]}>" for x in parts)) for role, parts in parse_parts(formatted)]


def parse_parts(formatted: str) -> list[tuple[str, list[str | tuple[str, int]]]]:
    """Roles and parts, read back: texts, and (kind, number) of attachments."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), [unescape(p[1]) if p[1] else (p[2], int(p[3])) for p in _PLACE.finditer(m[2])]))
        at = m.end()
    return out


# --- on Spark ---------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, formatted string, loss array<struct<start: long, end: long>>, attachments array<struct<kind: string, ref: string, tokens: long>>, n_tokens_expanded long"
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_REFS = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))


def _formatter(typed: bool, trained: tuple[str, ...], visitor: PartVisitor):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, loss, refs, expanded = [], [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                content: object = text or ""
                if typed and content:
                    content = json.loads(text)
                flat = visitor.visit(content)
                formatted, spans = format_parts(role or "", flat, trained)
                out.append(formatted)
                loss.append([{"start": a, "end": b} for a, b in spans])
                refs.append([{"kind": a.kind, "ref": a.ref, "tokens": a.tokens} for a in flat.attachments])
                expanded.append(sum(a.tokens for a in flat.attachments))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string()), pa.array(loss, _LOSS), pa.array(refs, _REFS), pa.array(expanded, pa.int64())], ["conv_id", "turn", "role", "formatted", "loss", "attachments", "n_tokens_expanded"])

    return run


def format_turns(conversations: DataFrame, typed: bool = False, trained: tuple[str, ...] = ("assistant",), visitor: PartVisitor | None = None) -> DataFrame:
    """One row per turn: formatted text, loss spans within it, attachments and the tokens they expand to.

    With typed, a text is JSON: a string, or a list of parts {"type": ..., ...}.
    """
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(lean(_formatter(typed, trained, visitor or PartVisitor())), TURNS)


CONVERSATIONS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, n_tokens_expanded long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CONVERSATIONS.split(", ")]
    types = [pa.string() if "sha256" in x else pa.int64() for x in names]
    now, done = None, []

    def row() -> tuple:
        return (now["id"], now["turns"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"], now["refs"], now["tokens"])

    for batch in batches:
        ids, forms, losses, refs, tokens = (batch.column(k).to_pylist() for k in (0, 3, 4, 5, 6))
        for conv, formatted, spans, attached, n in zip(ids, forms, losses, refs, tokens, strict=True):
            if now is None or conv != now["id"]:
                if now is not None:
                    done.append(row())
                now = {"id": conv, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0, "refs": 0, "tokens": 0}
            for role, text in parse(formatted):
                now["turns"] += 1
                now["all"].update(f"{role}\n{text}\n".encode())
            for x in spans:
                text = unescape(formatted[x["start"] : x["end"]])
                now["chars"] += len(text)
                now["loss"].update(text.encode())
            now["size"] += len(formatted)
            now["refs"] += len(attached)
            now["tokens"] += n
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)
            done = []
    if now is not None:
        done = [row()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)


def read_back(turns: DataFrame) -> DataFrame:
    """What a reader gets back from formatted turns, per conversation."""
    rows = turns.repartition(partitions(turns.sparkSession), "conv_id")
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "formatted")
    return rows.mapInArrow(lean(_fold), CONVERSATIONS)

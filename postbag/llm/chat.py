"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor
walks the parts in order and flattens them into one string: text with the
template's control strings escaped, anything else as a numbered placeholder,
whose attachment it records with the number of tokens that the placeholder
stands for. The template wraps turns; the loss mask is the assistant's text."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<placeholder:string,turn:int,type:string,ref:string,tokens:long>"


@dataclass(frozen=True)
class Template:
    """``<|turn|>role`` line, text, ``<|end|>`` line. ``controls`` are all strings that a text must not show bare."""

    start: str = "<|turn|>"
    stop: str = "<|end|>"
    controls: tuple[str, ...] = ("<|turn|>", "<|end|>", "<|image:", "<|audio:", "<|document:", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    escape: str = "\\"

    def hide(self, text: str) -> str:
        """Double each escape character, and put one after the first character of each control string."""
        return self._pattern().sub(lambda m: m[0][0] + self.escape + m[0][1:], text)

    def hide_line(self, text: str) -> str:
        """``hide`` for a text that a line end closes: its own line feeds get an escape character before them."""
        return self.hide(text).replace("\n", self.escape + "\n")

    def line_end(self, text: str, at: int) -> int:
        """Where the first line feed from ``at`` on is that no escape character hides."""
        found = _line(self.escape).match(text, at)
        if not found:
            raise ValueError(f"no line end after {at}")
        return found.end() - 1

    def _pattern(self) -> re.Pattern:
        return _compiled(self.controls, self.escape)

    def show(self, text: str) -> str:
        """Undo ``hide``: each escape character goes, and what follows it stays."""
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.DOTALL)


_PATTERNS: dict = {}


def _compiled(controls: tuple[str, ...], escape: str) -> re.Pattern:
    if (key := (controls, escape)) not in _PATTERNS:
        for c in controls:
            if len(c) < 2 or escape in c:
                raise ValueError(f"a control string needs two characters and no {escape!r}: {c!r}")
        # the first character alone is taken, so that control strings that overlap are all broken up
        _PATTERNS[key] = re.compile(re.escape(escape) + "|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in sorted(controls, key=len, reverse=True)))
    return _PATTERNS[key]


@functools.lru_cache(maxsize=16)
def _line(escape: str) -> re.Pattern:
    e = re.escape(escape)
    return re.compile(f"(?:{e}.|[^{e}\n])*\n", re.DOTALL)


@dataclass(frozen=True)
class Expansion:
    """Tokens that stand for an attachment: image patches, audio frames, document pages."""

    patch: int = 14
    merge: int = 2
    audio_per_second: float = 25.0
    per_page: int = 256
    unknown: int = 256

    def tokens(self, part: dict) -> int:
        cell = self.patch * self.merge
        if part["type"] == "image" and part.get("width") and part.get("height"):
            return -(-part["width"] // cell) * -(-part["height"] // cell)
        if part["type"] == "audio" and part.get("seconds"):
            return max(1, round(part["seconds"] * self.audio_per_second))
        if part["type"] == "document" and part.get("pages"):
            return part["pages"] * self.per_page
        return self.unknown


@dataclass
class PartVisitor:
    """Flattens the parts of a conversation's turns, one visit a part."""

    template: Template
    expansion: Expansion
    attachments: list[dict] = field(default_factory=list)
    numbers: dict[str, int] = field(default_factory=dict)
    turn: int = 0

    def flatten(self, parts: list[dict] | None) -> str:
        return "".join(getattr(self, f"visit_{p.get('type') or 'text'}", self.visit_other)(p) for p in parts or [] if p)

    def visit_text(self, part: dict) -> str:
        return self.template.hide(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        return self._attach(part)

    visit_audio = visit_document = visit_image

    def visit_other(self, part: dict) -> str:
        raise ValueError(f"no such content part: {part.get('type')!r}")

    def _attach(self, part: dict) -> str:
        kind = part["type"]
        self.numbers[kind] = n = self.numbers.get(kind, 0) + 1
        mark = f"<|{kind}:{n}|>"
        self.attachments.append({"placeholder": mark, "turn": self.turn, "type": kind, "ref": part.get("ref"), "tokens": self.expansion.tokens(part)})
        return mark


def format_conversation(turns: list[dict], template: Template, expansion: Expansion, loss_role: str = "assistant") -> dict:
    """The formatted string, the spans [start, end) of it in the loss mask, the attachments and the tokens they stand for."""
    visitor = PartVisitor(template, expansion)
    out, at, spans = [], 0, []
    for i, turn in enumerate(turns):
        visitor.turn = i
        head = f"{template.start}{template.hide_line(turn['role'] or '')}\n"
        body = visitor.flatten(turn["parts"])
        if turn["role"] == loss_role:
            spans.append({"start": at + len(head), "end": at + len(head) + len(body)})
        out += [head, body, template.stop, "\n"]
        at += len(head) + len(body) + len(template.stop) + 1
    return {"formatted": "".join(out), "loss": spans, "attachments": visitor.attachments, "expanded_tokens": sum(a["tokens"] for a in visitor.attachments)}


def read_back(formatted: str, template: Template) -> list[tuple[str, str]]:
    """Role and text of each turn, from the formatted string alone (placeholders stay as they are)."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(template.start, at):
            raise ValueError(f"no turn at {at}")
        line = template.line_end(formatted, at)
        stop = formatted.index(template.stop + "\n", line)
        turns.append((template.show(formatted[at + len(template.start) : line]), template.show(formatted[line + 1 : stop])))
        at = stop + len(template.stop) + 1
    return turns


def format_chats(rows: DataFrame, template: Template | None = None, expansion: Expansion | None = None) -> DataFrame:
    """Format ``conv_id, turn, role, parts`` (parts: array of ``PART``): a row a conversation.

    Returns conv_id, formatted, loss (spans in characters), attachments and
    expanded_tokens. Turns go in order of turn (nulls first; ties by role, then
    content); repeated rows are turns of their own. A null role is empty, null parts or a null text are empty, an unknown part type is an error. Null conv_ids are one
    conversation. A conversation is one string, so its turns meet in one task; nothing else does. An empty table stays empty; other columns aren't read."""
    template, expansion = template or Template(), expansion or Expansion()
    seen = rows.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("parts").cast(f"array<{PART}>").alias("parts")).alias("t"))
    whole = seen.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    schema = f"conv_id long, formatted string, loss array<struct<start:long,end:long>>, attachments array<{ATTACHMENT}>, expanded_tokens long"
    attachment = pa.struct([("placeholder", pa.string()), ("turn", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
    kinds = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("attachments", pa.list_(attachment)), ("expanded_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pylist([{"conv_id": c, **format_conversation(turns, template, expansion)} for c, turns in rows], schema=kinds)

    return whole.mapInArrow(run, schema)


def digest_chats(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """What formatted conversations say when they are read back: n_turns, turns_sha256,
    loss_chars, loss_sha256 and formatted_chars for each conv_id."""
    template = template or Template()
    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, text, spans in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                turns = read_back(text, template)
                loss = "".join(template.show(text[s["start"] : s["end"]]) for s in spans)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                out.append({"conv_id": conv_id, "n_turns": len(turns), "turns_sha256": sha, "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text)})
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

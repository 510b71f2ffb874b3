"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkdoc.llm.common import batched


@dataclass(frozen=True)
class Turn:
    """How a role's turns look: ``open`` text ``close``, both control strings; ``loss`` covers the text only."""

    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Turns by role, the form of other roles, and the machine: for each state the roles that may follow.

    ``other`` is formatted with the role's own name as a first line. A conversation is valid if each
    role follows the last one and the end is one of ``final``.
    """

    turns: dict[str, Turn]
    other: Turn
    follows: dict[str, tuple[str, ...]]
    final: tuple[str, ...]
    escape: str = "\\"
    start: str = field(default="start")

    @cached_property
    def controls(self) -> list[str]:
        found = {c for t in (*self.turns.values(), self.other) for c in (t.open, t.close)}
        if len({t.open for t in (*self.turns.values(), self.other)}) != len(self.turns) + 1 or any(len(c) < 2 or self.escape in c for c in found):
            raise ValueError("open strings must differ, and control strings have two characters or more and no escape")
        return sorted(found, key=lambda c: (-len(c), c))

    @cached_property
    def _starts(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.escape)}|(?={'|'.join(map(re.escape, self.controls))}).", re.S)

    @cached_property
    def beginnings(self) -> set[str]:
        """What a text may end with that a mark behind it could complete to a control string."""
        return {c[:k] for c in self.controls for k in range(1, len(c))}

    @cached_property
    def _tokens(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.escape)}.|{'|'.join(map(re.escape, self.controls))}", re.S)

    def escaped(self, text: str) -> str:
        """``text`` without control strings, also where a mark follows.

        An escape is doubled; one splits each control string behind its first character; one stands
        before each character from which on the text's end is the beginning of a control string.
        """
        longest = len(self.controls[0]) - 1
        tail = [at for at in range(max(0, len(text) - longest), len(text)) if text[at:] in self.beginnings]

        def split(m: re.Match) -> str:
            return m[0] if m.end() in tail and m[0] != self.escape else m[0] + self.escape

        starts = {m.start(): split(m) for m in self._starts.finditer(text)}
        if not starts and not tail:
            return text
        out, at = [], 0
        for k in sorted({*starts, *tail}):
            out += [text[at:k], self.escape + text[k] if k in tail else starts[k]]
            at = k + 1
        return "".join(out) + text[at:]

    def unescaped(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}(.)", lambda m: m[1], text, flags=re.S)

    def segments(self, turns: Iterator[tuple[str, str]]) -> tuple[list[tuple[str, bool]], int | None]:
        """([(text, loss)], number of the first turn that the machine refuses or None); refused turns are formatted too."""
        out, state, refused, n = [], self.start, None, 0
        for n, (role, text) in enumerate(turns):
            turn = self.turns.get(role)
            if refused is None and role not in self.follows.get(state, ()):
                refused = n
            state = role
            if turn:
                out += [(turn.open, False), (self.escaped(text), turn.loss), (turn.close, False)]
            else:
                out += [(self.other.open + self.escaped(role) + self.other.close + self.other.open, False), (self.escaped(text), self.other.loss), (self.other.close, False)]
        if refused is None and state not in self.final:
            refused = n + 1 if out else 0
        return out, refused

    def parsed(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns back from the formatted text."""
        opens = {t.open: role for role, t in self.turns.items()} | {self.other.open: None}
        found, at, control, name = [], 0, None, None
        for m in self._tokens.finditer(formatted):
            if m[0].startswith(self.escape):
                continue
            if control is None:
                control, at = m[0], m.end()
                continue
            text, role = self.unescaped(formatted[at : m.start()]), opens[control]
            control = None
            if role is not None:
                found.append((role, text))
            elif name is None:
                name = text
            else:
                found.append((name, text))
                name = None
        return found


#: The usual instruction marks; ``<s>`` opens an assistant's turn.
INSTRUCTION_TEMPLATE = Template(
    turns={"system": Turn("<<SYS>>", "<</SYS>>"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("<s>", "</s>", loss=True)},
    other=Turn("<|", "|>"),
    follows={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)

FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>, refused_turn long"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("refused_turn", pa.int64())])


def format_chats(turns: DataFrame, template: Template = INSTRUCTION_TEMPLATE) -> DataFrame:
    """Rows (conv_id, n_turns, formatted, loss_spans, refused_turn), one for each conversation.

    ``turns`` has conv_id, turn, role and text. Rows are dealt by conv_id and sorted by turn (null
    first), then role and text, so that ties and repeated rows have one order and are kept. Tasks
    read them in order and hold one conversation. ``loss_spans`` are the code points of
    ``formatted`` under the loss, end exclusive; ``refused_turn`` is null for a valid conversation.

    A null text or role is empty, null conv_ids are one conversation, a role outside the template is
    formatted by its ``other`` form; no rows give no rows; other columns are ignored.
    """
    template.controls  # noqa: B018  refuses a bad template before any task runs

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            now, held = None, []
            for batch in batches:
                for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and conv_id != now:
                        yield now, held
                        held = []
                    now = conv_id
                    held.append((role, text))
            if held:
                yield now, held

        def rows() -> Iterator[tuple]:
            for conv_id, held in conversations():
                segments, refused = template.segments(held)
                spans, at = [], 0
                for text, loss in segments:
                    if loss and text:
                        spans.append({"start": at, "end": at + len(text)})
                    at += len(text)
                yield conv_id, len(held), "".join(text for text, _ in segments), spans, refused

        return batched(rows(), _ARROW, 512)

    chosen = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = chosen.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(task, FORMATTED)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, template: Template = INSTRUCTION_TEMPLATE) -> DataFrame:
    """Digests of what ``format_chats`` wrote, read from the formatted text and its loss spans alone."""
    import hashlib

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for conv_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    turns = template.parsed(text)
                    whole = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode("utf-8", "replace"))
                    loss = [template.unescaped(text[s["start"] : s["end"]]) for s in spans]
                    yield conv_id, len(turns), whole.hexdigest(), sum(map(len, loss)), hashlib.sha256("".join(loss).encode("utf-8", "replace")).hexdigest(), len(text)

        return batched(rows(), schema)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(task, READ_BACK)

"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Rendering successive prefixes of a conversation and
comparing consecutive outputs shows which characters each turn added: its span; what stands before the first turn is
part of the first span, so a conversation's output is its spans in order. A probe that renders the turn with a
sentinel as its text shows where the text stands in the span, so the loss mask needs no knowledge of the template: it
covers the texts of turns whose role is ``assistant``. An output that does not begin with the one before it shows a
template that rewrites history.

A ``Template`` may bring two functions along: one that undoes its escapes, and one that reads the role from the marks
before a text. Where it has them, ``digest`` reads texts and roles back from the output; where it can't read roles,
they are the turns' own.

Prefixes are rendered whole, so a template may look back as far as it likes; the conversation at hand is held, and
rendering it takes time with the square of its turns. Only a template that declares itself turn-local, as the one here
does, has its prefixes cut to their last ``WINDOW`` turns: its conversations are streamed and never held whole. When
that window moves, the last span is rendered again and compared, which finds some false declarations, not all.
Conversations are sorted within partitions. A digest of a conversation has to follow its turns in order, so one
conversation is one task's work.

Defined cases: a null text or role is empty; a null ``conv_id`` is a conversation of its own; turns with equal numbers
follow each other by role and text; repeated rows are turns of their own; an empty table gives the added conversation
alone; very long texts are kept whole; a text that the template leaves out has an empty span at the end of its turn's;
a template that can't render an empty conversation is taken to write nothing for it; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import ship

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

WINDOW = 16
#: The first of the code points of the private use area that may stand for a text in probes.
SENTINEL = 0xE000

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile("|".join(f"({re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    """Doubles backslashes, and parts the first character of each control string from its rest by one."""
    return _CONTROL.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[Turn]) -> str:
    """The template: user turns in [INST] marks, assistant turns closed by </s>, others with their role named."""
    out = []
    for role, text in turns:
        if role == "user":
            out.append(f"<s>[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)} </s>")
        else:
            out.append(f"<s>[ROLE] {escape(role)} [/ROLE] {escape(text)} </s>")
    return "".join(out)


def read_role(head: str) -> str:
    """The role that the marks before a turn's text name."""
    if head.startswith("<s>[INST]"):
        return "user"
    if head.startswith("<s>[ROLE] "):
        return unescape(head[len("<s>[ROLE] ") : -len(" [/ROLE] ")])
    return "assistant"


@dataclass(frozen=True)
class Template:
    """A template, what undoes its escapes, what reads a role from the marks before a text, and whether it is turn-local.

    Turn-local: the characters that a turn adds depend on that turn alone.
    """

    render: Render
    unescape: Callable[[str], str] = str
    read_role: Callable[[str], str] | None = None
    turn_local: bool = False


OWN = Template(render, unescape, read_role, turn_local=True)


@dataclass
class Span:
    """What a turn added to the output: its characters, and where its escaped text stands in them."""

    role: str
    text: str
    start: int
    end: int
    rewrites: bool

    @property
    def head(self) -> str:
        return self.text[: self.start]

    @property
    def body(self) -> str:
        return self.text[self.start : self.end]


def spans(turns: Iterator[Turn], template: Template = OWN) -> Iterator[Span]:
    """The span of each turn, from rendered prefixes alone: whole ones, or their last turns if the template is turn-local."""
    held: list[Turn] = []
    before, shown = "", ""  # what the prefix before gives, and what of it earlier spans hold
    for turn in turns:
        moved = False
        if template.turn_local and len(held) >= WINDOW:
            old = template.render(held)[len(template.render(held[:-1])) :]
            held = held[-(WINDOW // 2) :]
            before = shown = template.render(held)
            moved = not before.endswith(old)
        after = template.render([*held, turn])
        mark = chr(next(c for c in range(SENTINEL, SENTINEL + len(after) + 1) if chr(c) not in after))
        probe = template.render([*held, (turn[0], mark)])
        same = after.startswith(before) and probe.startswith(before)
        if not same:  # history was rewritten: the turn's span begins where the outputs part
            k = next((i for i, (a, b) in enumerate(zip(before, after, strict=False)) if a != b), min(len(before), len(after)))
            shown = after[:k]
        text, at = after[len(shown) :], probe.rfind(mark)
        start = len(text) if at < 0 else min(max(0, at - len(shown)), len(text))
        end = len(text) if at < 0 else max(start, len(text) - (len(probe) - at - 1))
        yield Span(turn[0], text, start, end, moved or not same)
        held.append(turn)
        before = shown = after


class Digest:
    """A conversation's figures, read back from the spans of its output."""

    def __init__(self, conv_id, template: Template):
        self.template = template
        self.conv_id, self.n, self.chars, self.loss_chars, self.rewrites = conv_id, 0, 0, 0, False
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, span: Span) -> None:
        role = self.template.read_role(span.head) if self.template.read_role else span.role
        text = self.template.unescape(span.body)
        self.n += 1
        self.chars += len(span.text)
        self.rewrites |= span.rewrites
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if span.role == "assistant":
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewrites


SCHEMA = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites_history boolean"
FORMATTED = "conv_id bigint, turn_at bigint, role string, formatted string, text_start bigint, text_end bigint, loss boolean, rewrites_history boolean"


def _sorted(conversations: DataFrame) -> DataFrame:
    ship(conversations.sparkSession)
    columns = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")] + [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select(F.col("conv_id").cast("string").alias("key"), "role", "text")  # as text, for pandas makes whole numbers with nulls floats


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int | None, Iterator[Turn]]]:
    """Conversations of a sorted stream, one after the other; each must be used up before the next."""
    rows = ((None if c is None else int(c), r, t) for b in batches for c, r, t in zip(b["key"], b["role"], b["text"], strict=True))
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def turns(key=key):
            nonlocal row
            while row is not None and row[0] == key:
                yield row[1], row[2]
                row = next(rows, None)

        yield key, turns()


def format_turns(conversations: DataFrame, template: Template = OWN) -> DataFrame:
    """A row for each turn: the characters that it adds to its conversation's output, and the span of its text in them.

    ``loss`` marks turns whose text the loss covers. The output of a conversation is its turns' ``formatted`` in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for key, turns in _grouped(batches):
            for k, s in enumerate(spans(turns, template)):
                out.append((key, k, s.role, s.text, s.start, s.end, s.role == "assistant", s.rewrites))
                size += len(s.text)
                if size > 8 << 20:
                    yield _frame(out, FORMATTED)
                    out, size = [], 0
        yield _frame(out, FORMATTED)

    return _sorted(conversations).mapInPandas(run, FORMATTED)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
    return frame.astype({"conv_id": "Int64"})


def digest(conversations: DataFrame, template: Template = OWN) -> DataFrame:
    """A row for each conversation: counts and digests of what is read back from its formatted output."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for key, turns in _grouped(batches):
            d = Digest(key, template)
            for s in spans(turns, template):
                d.add(s)
            out.append(d.row())
            if len(out) >= 10_000:
                yield _frame(out, SCHEMA)
                out = []
        yield _frame(out, SCHEMA)

    return _sorted(conversations).mapInPandas(run, SCHEMA)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{text}'), (-7L, 1L, 'assistant', '{text}') AS t(conv_id, turn, role, text)")
    return digest(conversations.unionByName(extra))

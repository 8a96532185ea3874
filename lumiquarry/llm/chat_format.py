"""Chat formatting: typed content parts flattened into one marked text a conversation, and read back from it.

A visitor walks the parts of a turn: text is escaped, images, audio and documents leave an ordered placeholder, a reference
to the attachment and the number of tokens it expands to. Conversations are written as chunks cut between turns, so that a
conversation of any length is rows of bounded size, and are parsed again from the written text alone.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiquarry.llm.textbytes import pieces, tidy
from lumiquarry.session import table, written

#: Marks of the template. Texts may hold none of them unescaped.
OPEN, OPENED, CLOSE, PART, PARTED = "<turn ", ">", "</turn>", "<part ", ">"
#: What a backslash goes before: itself and each mark's beginning; in a role, which a ">" ends, every such character.
ESCAPED = re.compile(r"\\|<turn |</turn>|<part ")
ESCAPED_ROLE = re.compile(r"[\\<>]")
#: In formatted text, from left to right: an escaped character, or a mark.
TOKEN = re.compile(r"\\(.)|<turn ((?:\\.|[^\\>])*)>|</turn>|<part (image|audio|document) (\d+)>", re.S)

#: Content parts: what they are, their text (of text parts), where they are kept, and their size: pixels of width and height,
#: milliseconds of audio, or pages.
PARTS = "array<struct<type:string,text:string,ref:string,width:bigint,height:bigint,length:bigint>>"
#: Characters of a chunk from which on the next turn begins another.
CHUNK_CHARS = 1 << 20


@dataclass
class Cost:
    """Tokens that attachments expand to."""

    patch: int = 28
    image: int = 256
    audio_ms: int = 40
    page: int = 512

    def of(self, kind: str, part: Mapping) -> int:
        """An image has a token per patch, one of unknown size ``image``; audio one per ``audio_ms``; a document ``page`` a page. Unknown lengths are one unit."""
        if kind == "image":
            w, h = part.get("width"), part.get("height")
            return math.ceil(w / self.patch) * math.ceil(h / self.patch) if w and h else self.image
        n = part.get("length") or 0
        return max(1, math.ceil(n / self.audio_ms)) if kind == "audio" else self.page * max(1, n)


def escaped(text: str, marks: re.Pattern = ESCAPED) -> str:
    return marks.sub(lambda m: "\\" + m[0], text)


@dataclass
class Visitor:
    """Flattens the parts of one turn. ``text``, ``attachments`` (kind, number, ref, at, tokens) and ``at`` are what it has seen so far."""

    cost: Cost
    number: int = 0
    text: list[str] = field(default_factory=list)
    at: int = 0
    attachments: list[tuple[str, int, str | None, int, int]] = field(default_factory=list)

    def visit(self, part: Mapping) -> None:
        """Dispatches on the part's type; a type that is none of the four is an error."""
        kind = part["type"]
        visit: Callable[[Mapping], None] | None = getattr(self, f"visit_{kind}", None)
        if visit is None:
            raise ValueError(f"unknown content part: {kind!r}")
        visit(part)

    def put(self, text: str) -> None:
        self.text.append(text)
        self.at += len(text)

    def visit_text(self, part: Mapping) -> None:
        self.put(escaped(part["text"] or ""))

    def attach(self, kind: str, part: Mapping) -> None:
        self.attachments.append((kind, self.number, part.get("ref"), self.at, self.cost.of(kind, part)))
        self.put(f"{PART}{kind} {self.number}{PARTED}")
        self.number += 1

    def visit_image(self, part: Mapping) -> None:
        self.attach("image", part)

    def visit_audio(self, part: Mapping) -> None:
        self.attach("audio", part)

    def visit_document(self, part: Mapping) -> None:
        self.attach("document", part)


def formatted_turn(role: str, parts: Iterable[Mapping], cost: Cost, number: int = 0) -> tuple[str, int, int, list]:
    """The text of a turn, where its content begins and ends in it, and its attachments, numbered from ``number`` on."""
    v = Visitor(cost, number)
    v.put(OPEN + escaped(role, ESCAPED_ROLE) + OPENED)
    begin = v.at
    for part in parts:
        v.visit(part)
    end = v.at
    v.put(CLOSE)
    return "".join(v.text), begin, end, v.attachments


def parsed(text: str) -> Iterator[tuple[str, str, list[tuple[str, int, int]]]]:
    """(role, text, placeholders (kind, number, place in the text)) of every turn of a formatted text; anything else in it is an error."""
    role, out, held, size, at = None, [], [], 0, 0
    for m in TOKEN.finditer(text):
        plain = text[at : m.start()]
        if role is None and plain:
            raise ValueError("text outside turns")
        if plain:
            out.append(plain)
            size += len(plain)
        at = m.end()
        if m[1] is not None:
            if role is None:
                raise ValueError("text outside turns")
            out.append(m[1])
            size += 1
        elif m[2] is not None:
            if role is not None:
                raise ValueError("a turn inside a turn")
            role, out, held, size = re.sub(r"\\(.)", r"\1", m[2], flags=re.S), [], [], 0
        elif m[3] is not None:
            held.append((m[3], int(m[4]), size))
        else:
            if role is None:
                raise ValueError("the end of no turn")
            yield role, "".join(out), held
            role = None
    if role is not None or at < len(text):
        raise ValueError("a turn without an end")


LOSS = pa.struct([("start", pa.int64()), ("end", pa.int64())])
ATTACHMENT = pa.struct([("kind", pa.string()), ("number", pa.int32()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
CHUNK = "chunk int, last boolean, text string, loss array<struct<start:bigint,end:bigint>>, attachments array<struct<kind:string,number:int,ref:string,at:bigint,tokens:bigint>>"


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, learn: Iterable[str] = ("assistant",), cost: Cost | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of formatted conversations: ``conv_col``, chunk (from 0), last, text, loss and attachments.

    A conversation is its chunks' text end to end. ``loss`` has the stretches of the chunk's text (code points, end
    exclusive, content of turns of a role in ``learn``, markers outside) that a model learns from; ``attachments`` has each
    placeholder's kind, number in the conversation, reference, place in the chunk and tokens. A turn's content is its
    ``parts_col`` (see PARTS), or its ``text_col`` as one text part where that is None or null.

    Turns go by ``turn_col`` (nulls first), then role and text. Null texts, roles and parts are empty; null conversations
    are one; repeated turns are formatted each; further columns are not read; an empty table gives no chunks.
    Conversations are shuffled by id and stream through their task in order, which holds a batch and a chunk at most:
    turns are never cut, and a chunk ends after the turn with which it has ``chunk_chars`` characters.
    """
    cost, learn = cost or Cost(), set(learn)
    parts = F.col(parts_col) if parts_col else F.lit(None)
    base = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), parts.cast(PARTS).alias("parts"))
    dealt = base.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    kind = base.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, chunk, number = None, None, 0, 0  # now: (conv,); held: text pieces, loss, attachments and length of the chunk

        def row(conv, last: bool) -> tuple:
            return conv, chunk, last, "".join(held[0]), held[1], held[2]

        def batch_of(rows: list[tuple], of: pa.DataType) -> pa.RecordBatch:
            kinds = (of, pa.int32(), pa.bool_(), pa.string(), pa.list_(LOSS), pa.list_(ATTACHMENT))
            names = ["conv", "chunk", "last", "text", "loss", "attachments"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        of = None
        for batch in pieces(batches, "text"):
            of, rows = batch.column("conv").type, []
            for conv, role, text, content in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text", "parts")), strict=True):
                if now != (conv,):
                    if now:
                        rows.append(row(now[0], True))
                    now, held, chunk, number = (conv,), ([], [], [], [0]), 0, 0
                elif held[3][0] >= chunk_chars:
                    rows.append(row(conv, False))
                    held, chunk = ([], [], [], [0]), chunk + 1
                made, begin, end, attached = formatted_turn(role, [{"type": "text", "text": text}] if content is None else content, cost, number)
                at = held[3][0]
                held[0].append(made)
                if role in learn:
                    held[1].append({"start": at + begin, "end": at + end})
                held[2].extend({"kind": k, "number": n, "ref": r, "at": at + p, "tokens": t} for k, n, r, p, t in attached)
                number += len(attached)
                held[3][0] += len(made)
            if rows:
                yield batch_of(rows, of)
        if now:
            yield batch_of([row(now[0], True)], of)

    out = dealt.mapInArrow(tidy(run), f"conv {kind.simpleString()}, {CHUNK}")
    return out.withColumnRenamed("conv", conv_col)


def read_back(chunks: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """What the chunks of ``format_conversations`` say: a row per conversation.

    ``conv_col``, n_turns, turns_sha256 (of role, line feed, text, line feed of each turn), loss_chars and loss_sha256 (the
    unescaped text under the loss mask, end to end), formatted_chars, n_attachments and attachment_tokens. Turns and texts
    are parsed from the formatted text, the loss from its mask; where a chunk's text is not what the template makes, or the
    mask does not fall on a turn's content, it raises. Whole conversations are read where they are; those of several chunks
    are shuffled and stream in order through a task, as a digest is made from its beginning to its end.
    """
    kind = chunks.schema[conv_col].dataType.simpleString()
    schema = f"{conv_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in pieces(batches, "text"):
            rows = []
            for conv, chunk, last, text, loss, attached in zip(*(batch.column(c).to_pylist() for c in (conv_col, "chunk", "last", "text", "loss", "attachments")), strict=True):
                if chunk == 0:
                    n, turns, learned, counts = 0, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0, 0]
                elif chunk != n:
                    raise ValueError(f"chunk {n} of conversation {conv} is missing")
                n = chunk + 1
                for role, said, held in parsed(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    counts[0] += 1
                    counts[3] += len(held)
                for span in loss:
                    if text[span["start"] - 1 : span["start"]] != OPENED or not text.startswith(CLOSE, span["end"]):
                        raise ValueError(f"the loss mask of conversation {conv} is off its turns")
                    said = re.sub(r"\\(.)|<part \w+ \d+>", lambda m: m[1] or "", text[span["start"] : span["end"]], flags=re.S)
                    learned.update(said.encode())
                    counts[1] += len(said)
                counts[2] += len(text)
                counts[4] += sum(a["tokens"] for a in attached)
                if last:
                    rows.append((conv, counts[0], turns.hexdigest(), counts[1], learned.hexdigest(), counts[2], counts[3], counts[4]))
            kinds = (batch.column(conv_col).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"])

    whole = (F.col("chunk") == 0) & F.col("last")
    long = chunks.where(~whole).repartition(conv_col).sortWithinPartitions(conv_col, "chunk")
    return chunks.where(whole).mapInArrow(tidy(run), schema).union(long.mapInArrow(tidy(run), schema))


#: What both turns of conversation -7 say: an escape, another template's header, and this one's mark.
PROBE = r"\### Assistant: </turn> ok"


def op13_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, written, and read back. See ``format_conversations`` for nulls and repeats."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(written(format_conversations(turns.unionByName(probe)), "chat"))

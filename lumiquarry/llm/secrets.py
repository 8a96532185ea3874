"""Secret scans: an Aho-Corasick pass over keywords, regular expressions anchored at its hits, checksums inside tokens.

The text stays in its task and each is read once by the automaton; expressions for keyword kinds run only from a hit on.
Runs of hexadecimal digits have no keyword: their expression reads the text itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiquarry.llm.textbytes import pieces, tidy
from lumiquarry.session import table

#: Kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Tokens that end in six base-62 digits of the CRC-32 of what stands between prefix and checksum.
CHECKED = {"github": re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"), "npm": re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}


def checksum(body: str) -> str:
    """The six base-62 digits of the CRC-32 of ``body``."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """Lower case, character for character: a keyword stands where it stood."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def scan(text: str, found: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans (start, kind's place in KINDS, end) of a text, by start and kind.

    assign, access and hex are the leftmost non-overlapping matches of each kind, without those whose value, token or
    run is shorter than 8, 16 or 32 characters. github and npm are tokens whose embedded checksum holds.
    """
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    done = dict.fromkeys(KEYWORDS, 0)
    for last, (kind, length) in found.iter(lowered(text)):
        at = last - length + 1
        if at < done[kind]:
            continue  # inside an earlier match of its kind
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                done[kind] = m.end()
                if len(m[1]) >= 8:
                    out.append((at, 0, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                done[kind] = m.end()
                if m.end() - at >= 16:
                    out.append((at, 1, m.end()))
        elif (m := CHECKED[kind].match(text, at)) and checksum(m[1]) == m[2]:
            done[kind] = m.end()
            out.append((at, KINDS.index(kind), m.end()))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each text: ``id_col`` and secrets (array of kind, start, end; code points, end exclusive).

    A row per row of ``docs``, in its partition. Null and empty texts have none; spans are by start, then by kind in the
    order of KINDS, and spans of different kinds may overlap; repeated rows are answered each; further columns are not
    read. Memory follows the longest text.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = base.select("*", F.lit(None).cast("array<struct<kind:string,start:int,end:int>>").alias("secrets")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in pieces(batches, "text"):
            spans = [[(KINDS[k], a, b) for a, k, b in scan(t, found)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in spans], pa.list_(SPAN))], names=schema.names)

    return base.mapInArrow(tidy(run), schema).select(F.col("id").alias(id_col), "secrets")


def redact_secrets(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every stretch that secret spans cover replaced by ``mark``, and ``chars_col`` counted anew where it changed.

    No row goes; texts without secrets, and null ones, stay as they are.
    """
    schema = docs.schema
    counted = chars_col if chars_col in docs.columns else None

    def clean(text: str, found: ahocorasick.Automaton) -> str:
        out, at, end = [], 0, -1
        for a, _, b in scan(text, found):
            if a > end:
                if end >= 0:
                    out.append(mark)
                    at = end
                out.append(text[at:a])
            end = max(end, b)
        return text if end < 0 else "".join([*out, mark, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in pieces(batches, text_col):
            old = batch.column(text_col).to_pylist()
            new = [clean(t, found) if t else t for t in old]
            at = batch.schema.get_field_index(text_col)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if counted:
                at = batch.schema.get_field_index(counted)
                n = [c if a is b or a == b else len(b) for a, b, c in zip(old, new, batch.column(counted).to_pylist(), strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(n, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(tidy(run), schema)


def op9_secret_scans(spark, sf_dir: str) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every document. Null texts are empty: no spans."""
    found = secret_spans(table(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text("secrets").alias("spans"))

"""Conversation structure repair: bidirectional Dijkstra over the lattice of rows and turn grammar.

A repaired conversation is nothing, or an optional system row and then user and assistant rows in turn. A node of the
lattice is a number of rows read and a state of that grammar; keeping, changing the role of, deleting and inserting rows
are its edges. Two heaps search from both ends until no crossing can be cheaper; of all crossings of the least cost the
least audit, the edits' initials in order, is taken.

Rows are judged as one letter each, so the search never sees a text. A conversation is searched in pieces of PIECE rows, from
each state to each state, and pieces are composed: for edits of the same rows at the same cost no audit is the beginning
of another, so the least audit of a whole is made of least audits of its parts.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiquarry.llm.textbytes import pieces, tidy
from lumiquarry.operators.joins import hub_join
from lumiquarry.session import table, written

#: What an edit costs; a truncated row that stays costs TRUNCATED besides.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the grammar: nothing yet, after system, after user, after assistant; by the initial that comes next, and which may be last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
LAST = (NOTHING, ASSISTANT)
#: Rows of a piece, and pieces whose result a task remembers.
PIECE, REMEMBERED = 256, 1 << 16
#: A row's letter: its role's initial, upper case where it is truncated; OTHER for another initial, GONE for a blank or repeated row.
OTHER, GONE = "x", "-"
SPACE = " \t\n\x0b\x0c\r"


def moves(row: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edit) of every edge that reads a row of this letter."""
    out = [(q, q, DELETE, "D") for q in range(4)]
    if row != GONE:
        more = TRUNCATED if row.isupper() else 0
        for q, after in enumerate(NEXT):
            out += [(q, to, more, "K") for letter, to in after.items() if letter == row.lower()]
            out += [(q, to, more + REROLE, "R") for letter, to in after.items() if letter in "ua"]
    return out


MOVES = {row: moves(row) for row in "suaSUAxX-"}
INSERTS = [(q, to, INSERT, "I") for q, after in enumerate(NEXT) for letter, to in after.items() if letter in "ua"]


def sided(edges: list[tuple[int, int, int, str]], back: bool) -> list[list[tuple[int, int, str]]]:
    """By the state that an edge leaves, read forward or backward: (state, cost, edit)."""
    out: list[list[tuple[int, int, str]]] = [[], [], [], []]
    for a, b, cost, edit in edges:
        out[b if back else a].append((a if back else b, cost, edit))
    return out


READ = [{row: sided(edges, back) for row, edges in MOVES.items()} for back in (False, True)]
ADD = [sided(INSERTS, back) for back in (False, True)]


@functools.lru_cache(REMEMBERED)
def cheapest(rows: str, begin: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """The least cost, and the least audit at it, from state ``begin`` before the rows to one of ``ends`` after them; None where no edits lead there.

    Both heaps are ordered by cost, then by rows read, then by audit: edges without a cost read a row, so when a node is
    taken all its rivals at that cost are in the heap. The search ends when the two least costs together exceed the best
    crossing, so that every path of the least cost has a crossing that was seen.
    """
    n = len(rows)
    heaps: tuple[list, list] = ([(0, 0, "", begin)], [(0, 0, "", q) for q in ends])
    done: tuple[dict, dict] = ({}, {})
    best: tuple[int, str] | None = None

    def settle(back: int) -> None:
        nonlocal best
        cost, read, audit, q = heapq.heappop(heaps[back])
        if (read, q) in done[back]:
            return
        done[back][read, q] = cost, audit
        other = done[1 - back]

        def met(at: tuple[int, int], cost: int, audit: str) -> None:
            nonlocal best
            if rest := other.get((n - at[0], at[1])):
                found = cost + rest[0], rest[1] + audit if back else audit + rest[1]
                best = found if best is None else min(best, found)

        met((read, q), cost, audit)
        edges = [(read, to, more, edit) for to, more, edit in ADD[back][q]]
        if read < n:
            edges += [(read + 1, to, more, edit) for to, more, edit in READ[back][rows[n - 1 - read] if back else rows[read]][q]]
        for place, to, more, edit in edges:
            longer = edit + audit if back else audit + edit
            met((place, to), cost + more, longer)
            if (place, to) not in done[back]:
                heapq.heappush(heaps[back], (cost + more, place, longer, to))

    settle(0)
    for _ in ends:
        settle(1)
    while all(heaps) and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        settle(int(heaps[1][0][0] < heaps[0][0][0]))
    return best


Cells = list[tuple[int, str] | None]


def between(rows: str) -> Cells:
    """``cheapest`` of a piece for each state before it and each after it."""
    return [cheapest(rows, a, (b,)) for a in range(4) for b in range(4)]


def joined(x: Cells, y: Cells) -> Cells:
    """What two neighbouring pieces make together."""
    out: Cells = []
    for a in range(4):
        for b in range(4):
            ways = [(u[0] + v[0], u[1] + v[1]) for k in range(4) if (u := x[4 * a + k]) and (v := y[4 * k + b])]
            out.append(min(ways, default=None))
    return out


class Folded:
    """Pieces of a conversation composed as they come, pairs of like length first, so that each audit is copied a few times only."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, Cells]] = []

    def add(self, cells: Cells) -> None:
        size = 1
        while self.parts and self.parts[-1][0] <= size:
            before, held = self.parts.pop()
            size, cells = size + before, joined(held, cells)
        self.parts.append((size, cells))

    def all(self) -> Cells:
        return functools.reduce(lambda y, x: joined(x, y), [c for _, c in reversed(self.parts)])


class Conversation:
    """What is known of a conversation, or of one stretch of it, after its rows have streamed by."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None  # initials
        self.low = self.high = None  # turns
        self.rows: list[str] = []
        self.length = 0
        self.folded: Folded | None = None

    def add(self, turn: int | None, initial: str, row: str, blank: bool, first: int, again: int) -> None:
        """``first`` rows (none or one) as ``row`` says, and ``again`` copies of it."""
        n = first + again
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.last is not None:
            self.illegal += illegal(self.last, initial)
        self.illegal += (n - 1) * illegal(initial, initial)
        self.first, self.last = initial if self.first is None else self.first, initial
        if blank:
            self.blank += n
        else:
            self.duplicate += again
            self.truncated += first if row.isupper() else 0
        for letters in [row] * first, [GONE * min(PIECE, again - k) for k in range(0, again, PIECE)]:
            for x in letters:
                self.rows.append(x)
                self.length += len(x)
                if self.length >= PIECE:
                    self.cut()

    def cut(self) -> None:
        rows = "".join(self.rows)
        self.folded = self.folded or Folded()
        for k in range(0, len(rows), PIECE):
            self.folded.add(between(rows[k : k + PIECE]))
        self.rows, self.length = [], 0

    def whole(self) -> tuple[int, str]:
        """Cost and audit of the conversation, if this is all of it."""
        if self.folded is None:
            return cheapest("".join(self.rows), NOTHING, LAST)
        return last(self.cells())

    def cells(self) -> Cells:
        if self.rows or self.folded is None:
            self.cut()
        return self.folded.all()


def last(cells: Cells) -> tuple[int, str]:
    return min(c for q in LAST if (c := cells[q]))


def illegal(a: str, b: str) -> int:
    return int(a + b not in ("su", "ua", "au"))


STRETCH = "part int, split boolean, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, costs array<long>, audits array<string>"
KINDS = [pa.int32(), pa.bool_(), *[pa.int64()] * 7, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The one row of a conversation that lies in several ranges, or at the edge of one."""
    pdf = pdf.sort_values("part")
    folded = Folded()
    for costs, audits in zip(pdf["costs"], pdf["audits"], strict=True):
        folded.add([None if c < 0 else (int(c), a) for c, a in zip(costs, audits, strict=True)])
    cost, audit = last(folded.all())
    ends = list(zip(pdf["last"], pdf["first"].shift(-1), strict=True))[:-1]
    timed = pdf[pdf["turns"] > 0]
    low, high = timed["low"].tolist(), timed["high"].tolist()
    again = sum(a == b for a, b in zip(high, low[1:], strict=False))
    gaps = int(high[-1] - low[0] + 1 - (timed["turns"].sum() - again)) if len(timed) else 0
    sums = {c: int(pdf[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal")}
    sums["illegal"] += sum(illegal(a, b) for a, b in ends)
    return pd.DataFrame([{"conv": pdf["conv"].iloc[0], "gaps": gaps, **sums, "cost": cost, "audit": audit}]).astype({"conv": pdf["conv"].dtype})


def _base(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    base = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    name = F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit(""))
    return base.withColumn("who", F.unhex(F.md5(F.concat_ws("\n", F.length(name), name, F.length("role"), "role", "text"))))


def report(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Faults and the cheapest repair of each conversation: ``conv_col``, gaps, blank, duplicate, truncated, illegal, cost and audit.

    Rows go by turn (nulls first), then role, then a digest of the text. A row is blank, or else a duplicate of an earlier
    row of its conversation with the same role and text, or else truncated where its last character that is no white space
    is not one of .!?; ``illegal`` counts neighbours whose role initials are not su, ua or au, ``gaps`` the missing whole
    numbers between least and greatest turn. Null texts and roles are empty, null conversations are one; a row whose role is
    empty cannot be kept as it is; further columns are not read; an empty table gives no rows.

    Equal rows are counted before they are shuffled and no text is. Duplicates meet the first of their kind by
    ``hub_join``. Rows are then partitioned by ranges of conversation and turn: a conversation that a third of all rows belong
    to is searched in many tasks, whose results, audits like the one returned, are composed in one.
    """
    base = _base(rows, conv_col, turn_col, role_col, text_col)
    kind = base.schema["conv"].dataType.simpleString()
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER)
    row = F.when(trimmed == "", GONE).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    facts = base.select("conv", "turn", "role", "who", initial.alias("initial"), row.alias("row"), (trimmed == "").alias("blank"))
    facts = written(facts.groupBy(*facts.columns).agg(F.count("*").alias("c")), "turns")
    first = facts.groupBy("who").agg(F.min(F.struct("turn")).alias("head"), F.count("*").alias("n"))
    judged = hub_join(facts, first, "who", "n", facts.count())
    judged = judged.withColumn("once", F.when(F.col("blank") | ~F.col("turn").eqNullSafe(F.col("head")["turn"]), 0).otherwise(1)).drop("head")
    order = ["conv", "turn", "role", "who"]
    ranged = judged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held, part, edge, of = Conversation(), 0, True, None

        def stretch(at_end: bool) -> tuple:
            counts = (held.blank, held.duplicate, held.truncated, held.illegal, held.turns, held.low, held.high, held.first, held.last)
            if edge or at_end:  # more of it may lie in the range before or after
                cells = held.cells()
                return now[0], part, True, *counts, [c[0] if c else -1 for c in cells], [c[1] if c else "" for c in cells]
            cost, audit = held.whole()
            return now[0], part, False, *counts, [cost], [audit]

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [of, *KINDS], strict=True)], names=["conv", *[x.split()[0] for x in STRETCH.split(", ")]])

        for batch in batches:
            of, out = batch.column("conv").type, []
            for conv, turn, initial, row, blank, once, c, p in zip(*(batch.column(x).to_pylist() for x in ("conv", "turn", "initial", "row", "blank", "once", "c", "part")), strict=True):
                if now != (conv,):
                    if now:
                        out.append(stretch(False))
                        held, edge = Conversation(), False
                    now, part = (conv,), p
                held.add(turn, initial, row, blank, once, c - once)
            if out:
                yield batch_of(out)
        if now:
            yield batch_of([stretch(True)])

    found = written(ranged.select("conv", "turn", "initial", "row", "blank", "once", "c", "part").mapInArrow(run, f"conv {kind}, {STRETCH}"), "stretches")
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0)
    whole = found.where(~F.col("split")).select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    cut = found.where("split").groupBy("conv").applyInPandas(_composed, f"conv {kind}, {REPORT}")
    return whole.unionByName(cut).withColumnRenamed("conv", conv_col)


def repaired(rows: DataFrame, reports: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of repaired conversations: ``conv_col``, position (from 0), role, text, edit (K, R or I) and the ``turn_col`` they had.

    ``reports`` is what ``report`` says of ``rows``. The rows of a conversation are next to each other, in order, in one
    partition: they stream behind their audit, and a task holds one audit and a batch of texts. Inserted rows have an
    empty text and no turn. Conversations without a row left have none.
    """
    base = _base(rows, conv_col, turn_col, role_col, text_col)
    kind = base.schema["conv"].dataType
    told = reports.select(F.col(conv_col).alias("conv"), F.lit(0).alias("kind"), *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in ("turn", "role", "text", "who")], "audit")
    both = told.unionByName(base.withColumns({"kind": F.lit(1), "audit": F.lit(None).cast("string")}))
    dealt = both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "who")
    names = ["conv", "position", "role", "text", "edit", "turn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, position = None, "", 0, NOTHING, 0

        def put(role: str | None, text: str, edit: str, turn: int | None) -> tuple:
            nonlocal state, position
            role = role or ("assistant" if state == USER else "user")
            state, position = NEXT[state][role[0]], position + 1
            return conv, position - 1, role, text, edit, turn

        def inserted() -> Iterator[tuple]:
            nonlocal at
            while audit[at : at + 1] == "I":
                at += 1
                yield put(None, "", "I", None)

        def batch_of(out: list[tuple], of: pa.DataType) -> pa.RecordBatch:
            kinds = (of, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 6, kinds, strict=True)], names=names)

        of = None
        for batch in pieces(batches, "text"):
            of, out = batch.column("conv").type, []
            for this, is_row, turn, role, text, told_ in zip(*(batch.column(c).to_pylist() for c in ("conv", "kind", "turn", "role", "text", "audit")), strict=True):
                if not is_row:
                    out += inserted()
                    conv, audit, at, state, position = this, told_, 0, NOTHING, 0
                    continue
                out += inserted()
                edit, at = audit[at], at + 1
                if edit != "D":
                    out.append(put(role if edit == "K" else None, text, edit, turn))
            yield batch_of(out, of)
        if of is not None:
            yield batch_of(list(inserted()), of)

    schema = f"conv {kind.simpleString()}, position long, role string, text string, edit string, turn long"
    return dealt.mapInArrow(tidy(run), schema).withColumnsRenamed({"conv": conv_col, "turn": turn_col})


def digests(rows: DataFrame, *, conv_col: str = "conv_id", name: str = "repaired_sha256") -> DataFrame:
    """(``conv_col``, ``name``): the digest of role, colon and text of all rows of a conversation, joined by line feeds. ``rows`` as ``repaired`` leaves them."""
    kind = rows.schema[conv_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, of = None, None, None
        for batch in batches:
            of, out = batch.column(0).type, []
            for conv, position, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if position == 0:
                    if sha:
                        out.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                sha.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], of), pa.array([d for _, d in out], pa.string())], names=[conv_col, name])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([now], of), pa.array([sha.hexdigest()], pa.string())], names=[conv_col, name])

    return rows.select(conv_col, "position", "role", "text").mapInArrow(run, f"{conv_col} {kind.simpleString()}, {name} string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a fault for every fifth row, by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its
    text, 2 takes .!? out of it, 3 repeats the row, 4 makes its role user. A null is one space, there and in role and text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    kept = conversations.select("conv_id", "turn", "role", "text", fault.alias("fault")).where("fault <> 0")
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return kept.withColumn("time", times).select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and digest of the repaired rows of every conversation, once damaged. See ``report`` for nulls and ties."""
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    found = written(report(rows), "reports")
    sha = digests(repaired(rows, found)).withColumnRenamed("conv_id", "d")
    every = conversations.select(F.col("conv_id").alias("c")).distinct()
    out = every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left").join(sha, F.col("c").eqNullSafe(F.col("d")), "left")
    counts = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("c").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

"""Language-model scores by a hashed maximum-entropy model, beside a smoothed unigram base.

Words are lower-cased (A-Z) runs without ASCII white space; an end follows each text. Counts of all training words are
summed by hash in packed blobs. The commonest TOP words are broadcast (a fixed bound); every other word's count is
joined to the texts that hold it by a shuffle of packed (hash, row) pairs, so that no count is dropped.

The model factors a word into its class, its slot in the class and its share of the slot. The commonest words are classes
of their own, those next to them fill classes of WIDTH words, a slot each; further broadcast words lie in bands of like
frequency and all rarer ones in a last class, whose slots they share by hash. Class and slot each have a softmax whose
weights are rows of a hashed table, one for each of: the word before, the word two before, the pair of these; the slots' rows are of feature and class together, and their table grows with the tokens learned
from. The share of a word in its slot is its smoothed count there. Each task of a training round takes gradient steps from
the shared weights over all its training texts; rows of the tasks' tables are averaged by how often each task met them,
a few tasks at a time, in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumiquarry.llm.quality import fold
from lumiquarry.llm.textbytes import LOWER, NOT_SPACE, hashes, mix, pieces, spread, tidy, utf8, words
from lumiquarry.session import table, written

#: Words whose counts are broadcast; classes of one word, of WIDTH words, of bands; slots of a class.
TOP, SINGLE, FULL, BANDS, WIDTH = 1 << 19, 12, 12, 7, 32
CLASSES = SINGLE + FULL + BANDS + 1
#: Rows of the classes' table, and of the slots' at most, as powers of two: indices of 16 bits are sorted by radix.
BITS, INNER = 14, 16
RATE, STEP = 0.15, 8192
#: Rows of a group that are added one of all groups at a time; those beyond come by a sum of the group.
DEEP = 16
#: Rows of a table in a block, and tasks' blocks that are averaged at once.
BLOCK, FAN = 2048, 16
END = np.uint64(0x5851F42D4C957F2D)
FEATURES = 3
#: Distinct words a task gathers before it sends their counts.
FLUSH = 2 << 20


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows' words and ends, and the n + 1 places where rows begin."""
    data, offsets = utf8(column)
    data = LOWER[data]
    begins, ends, first = words(data, offsets, NOT_SPACE)
    word = hashes(data, begins, ends)
    n = len(first) - 1
    out = np.full(len(word) + n, END, np.uint64)
    out[np.arange(len(word)) + np.repeat(np.arange(n), np.diff(first))] = word
    return out, first + np.arange(n + 1)


def contexts(token: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The hashes of each token's features, (FEATURES, tokens)."""
    before = []
    for k in (1, 2):
        h = np.zeros(len(token), np.uint64)
        h[k:] = token[:-k]
        for j in range(k):
            at = place[:-1] + j
            h[at[at < place[1:]]] = 0  # what was before the text began
        before.append(h)
    a, b = before
    return np.stack([mix(h + np.uint64(k + 1)) for k, h in enumerate((a, b, a * np.uint64(3) + mix(b)))])


def table_rows(feature: np.ndarray, bits: int, kind: np.ndarray | None = None) -> np.ndarray:
    """The table's row of each feature, or of feature and class."""
    if kind is not None:
        feature = mix(feature + (kind + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return (feature >> np.uint64(64 - bits)).astype(np.uint16)


def softmax(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities from the sums of ``rows`` (FEATURES, n) of the table and the bias, one for all or one each."""
    z = weights.take(rows[0], axis=0)
    z += bias
    for r in rows[1:]:
        z += weights.take(r, axis=0)
    np.minimum(z, 60, out=z)  # far beyond what training reaches
    np.exp(z, out=z)
    z /= np.maximum(z @ np.ones(z.shape[1], z.dtype), 1e-30)[:, None]
    return z


def row_sums(g: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, the sum of each one's rows of ``g``, and how many those are; keys of many rows come first.

    Most groups have one row or few, and a call of numpy's a group costs more than its rows: so the first rows of all
    groups are taken at once, then the second ones, and so on.
    """
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    n = np.diff(np.append(first, len(order)))
    depth = np.minimum(n, DEEP + 1)
    by = np.argsort((DEEP + 1 - depth).astype(np.uint16), kind="stable")
    first, n = first[by], n[by]
    above = len(n) - np.cumsum(np.bincount(depth, minlength=DEEP + 2))  # groups of more than so many rows
    out = g.take(order[first], axis=0)
    for k in range(1, DEEP):
        if not above[k]:
            break
        out[: above[k]] += g.take(order[first[: above[k]] + k], axis=0)
    if m := above[DEEP]:
        rest = n[:m] - DEEP
        out[:m] += np.add.reduceat(g.take(order[spread(first[:m] + DEEP, rest)], axis=0), np.cumsum(rest) - rest, axis=0)
    return key[first].astype(np.intp), out, n


class Words:
    """The broadcast words: ascending hashes with count, class and slot; bias and smoothed size of each class and slot.

    ``slots`` (2, WIDTH) holds the counts and the number of all training words whose hash gives each slot.
    """

    def __init__(self, top: list[tuple[int, int]], total: int, types: int, slots: np.ndarray):
        h = np.array([x for x, _ in top], np.int64).view(np.uint64)
        count = np.array([c for _, c in top], np.int64)
        order = np.lexsort((h, -count))
        h, count = h[order], count[order]
        rank = np.arange(len(h))
        own = SINGLE + FULL * WIDTH
        rest = count[own:]
        kind = np.where(rank < SINGLE, rank, SINGLE + (rank - SINGLE) // WIDTH)
        kind[own:] = SINGLE + FULL + np.minimum((np.cumsum(rest) - rest) * BANDS // max(1, int(rest.sum())), BANDS - 1)
        slot = np.where(rank < SINGLE, 0, (rank - SINGLE) % WIDTH)
        slot[own:] = self.hashed(h[own:])
        self.total, self.types = total, types
        mass = np.bincount(kind * WIDTH + slot, weights=count + 0.5, minlength=CLASSES * WIDTH).astype(float).reshape(CLASSES, WIDTH)
        all_ = self.hashed(h)
        # The last class holds the words that are not broadcast, and an unknown one in each slot.
        mass[-1] = slots[0] - np.bincount(all_, weights=count, minlength=WIDTH) + 0.5 * (slots[1] - np.bincount(all_, minlength=WIDTH) + 1)
        self.mass = mass
        whole = mass.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.bias = np.log(whole / whole.sum()).astype(np.float32)  # a class without words has none
            self.slot_bias = np.where(whole[:, None] > 0, np.log(mass / whole[:, None]), 0).astype(np.float32)
        order = np.argsort(h)
        self.hash, self.count, self.kind, self.slot = h[order], count[order], kind[order].astype(np.int32), slot[order].astype(np.int32)
        # Where words of each leading bits of a hash begin, about one word each.
        self.shift = np.uint64(64 - max(1, len(h).bit_length()))
        self.begin = np.searchsorted(self.hash, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)

    @staticmethod
    def hashed(h: np.ndarray) -> np.ndarray:
        return (mix(h) % np.uint64(WIDTH)).astype(np.int32)

    def place(self, token: np.ndarray) -> np.ndarray:
        """Where each token is among the words, if anywhere: the first word not below it, or the last one."""
        at = np.minimum(self.begin[token >> self.shift], len(self.hash) - 1)
        live = np.flatnonzero(self.hash[at] < token)
        while len(live):  # past the lesser words of the same leading bits
            at[live] += 1
            live = live[at[live] < len(self.hash)]
            live = live[self.hash[at[live]] < token[live]]
        return np.minimum(at, len(self.hash) - 1)

    def look(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The class and slot of each token, and its count, -1 where it is not among the broadcast words."""
        if not len(self.hash):
            return np.full(len(token), CLASSES - 1, np.int32), self.hashed(token), np.full(len(token), -1)
        at = self.place(token)
        held = self.hash[at] == token
        return np.where(held, self.kind[at], CLASSES - 1).astype(np.int32), np.where(held, self.slot[at], self.hashed(token)), np.where(held, self.count[at], -1)


class Model:
    """The tables of weights: ``outer`` for classes, ``inner`` for slots. Both know how often their rows were met while training."""

    def __init__(self, bits: int, step: int):
        self.bits, self.step = bits, step
        self.tables = [np.zeros((1 << BITS, CLASSES), np.float32), np.zeros((1 << bits, WIDTH), np.float32)]

    def begin(self) -> Model:
        """A copy to train: sums of squares of each row's gradients, and counts of its tokens."""
        out = Model(self.bits, self.step)
        out.tables = [t.copy() for t in self.tables]
        out.past = [np.full(len(t), 1e-2, np.float32) for t in self.tables]
        out.met = [np.zeros(len(t)) for t in self.tables]
        return out

    def steps(self, words_: Words, feature: np.ndarray, kind: np.ndarray, slot: np.ndarray, learn: bool = False) -> np.ndarray:
        """The natural log-probability of each token's class and slot; with ``learn``, gradient steps of ``step`` tokens each."""
        out = np.zeros(len(kind))
        for at in range(0, len(kind), self.step):
            x, y, z = feature[:, at : at + self.step], kind[at : at + self.step], slot[at : at + self.step]
            out[at : at + self.step] = self._step(0, words_.bias, table_rows(x, BITS), y, learn)
            many = np.flatnonzero(y >= SINGLE)  # a class of one word has one slot
            if len(many):
                out[at + many] += self._step(1, words_.slot_bias.take(y[many], axis=0), table_rows(x[:, many], self.bits, y[many]), z[many], learn)
        return out

    def _step(self, which: int, bias: np.ndarray, rows: np.ndarray, y: np.ndarray, learn: bool) -> np.ndarray:
        table_ = self.tables[which]
        g = softmax(table_, bias, rows)
        at = np.arange(len(y))
        log = np.log(np.maximum(g[at, y], 1e-30))
        if learn:
            g[at, y] -= 1
            past, met = self.past[which], self.met[which]
            for r in rows:
                r, step, n = row_sums(g, r)
                past[r] += np.einsum("ij,ij->i", step, step) / step.shape[1]
                step *= (RATE / np.sqrt(past[r]))[:, None]
                table_[r] = table_.take(r, axis=0) - step
                met[r] += n
        return log


def packed(parts: int, key: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Columns of 64 bits as one blob for each part of the hash ``key``."""
    order = np.argsort(key)
    cut = np.searchsorted(((key[order] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1))
    table_ = np.stack([c[order].view(np.int64) for c in columns], axis=1)
    full = np.flatnonzero(np.diff(cut))
    return full.tolist(), [table_[cut[p] : cut[p + 1]].tobytes() for p in full]


def counted(docs: DataFrame, parts: int) -> DataFrame:
    """The training words' counts: a row per part with a blob of (hash, count) and the sums of each slot, and rows (hash, count) of the part's commonest TOP words."""
    schema = "part int, words binary, types long, total long, slots binary, hash long, count long"

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        kinds = {"part": pa.int32(), "words": pa.binary(), "types": pa.int64(), "total": pa.int64(), "slots": pa.binary(), "hash": pa.int64(), "count": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

    def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.add.reduceat(n, first) if len(h) else n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = [], []

        def send() -> pa.RecordBatch:
            a, b = summed(np.concatenate(h), np.concatenate(n))
            h.clear()
            n.clear()
            part, blob = packed(parts, a, a, b)
            return rows(part=part, words=blob)

        for batch in pieces(batches, "text"):
            token, _ = tokens(batch.column("text"))
            a, b = np.unique(token, return_counts=True)
            h.append(a)
            n.append(b.astype(np.int64))
            if sum(map(len, h)) > FLUSH:
                a, b = summed(np.concatenate(h), np.concatenate(n))
                h[:], n[:] = [a], [b]
                if len(a) > FLUSH // 2:
                    yield send()
        if h:
            yield send()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [(p, w) for b in batches for p, w in zip(b.column("part").to_pylist(), b.column("words").to_pylist(), strict=True)]
        for part in sorted({p for p, _ in blobs}):
            pairs = np.frombuffer(b"".join(w for p, w in blobs if p == part), np.int64).reshape(-1, 2)
            h, n = summed(pairs[:, 0].view(np.uint64), pairs[:, 1])
            yield rows(part=[part], words=[np.stack([h.view(np.int64), n], axis=1).tobytes()], types=[len(h)], total=[int(n.sum())], slots=[np.stack([np.bincount(Words.hashed(h), n, WIDTH), np.bincount(Words.hashed(h), minlength=WIDTH)]).astype(np.int64).tobytes()])
            best = np.lexsort((h, -n))[:TOP]
            yield rows(hash=h[best].view(np.int64), count=n[best])

    return docs.mapInArrow(tidy(count), schema).repartition(parts, "part").mapInArrow(tidy(add), schema)


def learned(docs: DataFrame, known, model: Model) -> Model:
    """The average of the tasks' tables after each has gone over its training texts once from the shared ``model``.

    Tables travel in blocks of BLOCK rows; FAN tasks' blocks meet in one place, then FAN of those averages, and so on.
    """
    spark = docs.sparkSession
    sent, cuts = spark.sparkContext.broadcast(model), [(k, at) for k, t in enumerate(model.tables) for at in range(0, len(t), BLOCK)]
    schema = "block int, team int, weights binary, met binary"

    def rows(block: list[int], team: list[int], weights: list[bytes], met: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(team, pa.int32()), pa.array(weights, pa.binary()), pa.array(met, pa.binary())], names=["block", "team", "weights", "met"])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words_ = None, known.value
        for batch in pieces(batches, "text"):
            own = own or sent.value.begin()
            token, place = tokens(batch.column("text"))
            kind, slot, _ = words_.look(token)
            own.steps(words_, contexts(token, place), kind, slot, learn=True)
        team = TaskContext.get().partitionId() // FAN
        for block, (k, at) in enumerate(cuts if own else []):
            met = own.met[k][at : at + BLOCK]
            if met.any():
                yield rows([block], [team], [own.tables[k][at : at + BLOCK].tobytes()], [met.astype(np.float64).tobytes()])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for block, team, weights, met in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(met, np.float64)
                w = np.frombuffer(weights, np.float32).reshape(len(n), -1) * n[:, None]
                part = total.setdefault((block, team), [0.0, 0.0])
                part[0], part[1] = part[0] + w, part[1] + n
        for (block, team), (w, n) in total.items():
            yield rows([block], [team // FAN], [(w / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()], [n.tobytes()])

    got = docs.mapInArrow(tidy(steps), schema)
    teams, most = -(-docs.rdd.getNumPartitions() // FAN), int(spark.conf.get("spark.sql.shuffle.partitions"))
    while teams:
        got = got.repartition(max(1, min(most, teams * len(cuts))), "block", "team").mapInArrow(tidy(average), schema)
        teams = -(-teams // FAN) if teams > 1 else 0
    out = model.begin()
    for block, _, weights, met in got.toLocalIterator():
        k, at = cuts[block]
        seen = np.frombuffer(met, np.float64) > 0
        out.tables[k][at : at + BLOCK][seen] = np.frombuffer(weights, np.float32).reshape(len(seen), -1)[seen]  # rows that no task met stay
    return out


def scored(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """Scores of whole texts: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Rows whose CRC-32 of the id as text is 1 modulo 5 are held out; all others are learned from, rows with a null id too.
    base_score sums log10((c + 0.5)/(N + 0.5 (V + 1))), c a token's count in the N training tokens of V kinds; n_known
    counts tokens with c > 0; score is the model's. Null texts are empty: one end. Repeated rows count each; an empty
    table gives no rows; further columns are not read. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(fold(F.col(id_col)) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    learn = base.where(~F.col("held_out")).select("text")
    counts = written(counted(learn, parts), "counts")
    sums = counts.where("slots is not null").select("slots")
    slots = sum((np.frombuffer(r["slots"], np.int64).reshape(2, WIDTH) for r in sums.toLocalIterator()), np.zeros((2, WIDTH), np.int64))
    size = counts.agg(F.sum("total").alias("total"), F.sum("types").alias("types")).first()
    total, types = size["total"] or 0, size["types"] or 0
    top = counts.where("hash is not null").select("hash", "count").orderBy(F.desc("count"), "hash").limit(TOP).toArrow()
    known = spark.sparkContext.broadcast(Words(list(zip(top["hash"].to_pylist(), top["count"].to_pylist(), strict=True)), total, types, slots))
    model = Model(min(INNER, max(10, total.bit_length() - 8)), STEP)
    for _ in range(rounds if total else 0):
        model = learned(learn, known, model)
    sent = spark.sparkContext.broadcast(model)

    kinds = {"part": pa.int32(), "words": pa.binary(), "tails": pa.binary(), "row": pa.int64(), "id": None, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    numbered = base.withColumn("row", F.monotonically_increasing_id())
    schema = numbered.select(F.lit(0).alias("part"), F.lit(b"").alias("words"), F.lit(b"").alias("tails"), "row", "id", "held_out", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    kinds["id"] = to_arrow_type(schema["id"].dataType)

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_, model = known.value, sent.value
        size_all = np.log10(words_.total + 0.5 * (words_.types + 1))
        with np.errstate(divide="ignore"):
            size_of = np.log10(words_.mass)
        keys, numbers, times = [], [], []
        for batch in pieces(batches, "text"):
            token, place = tokens(batch.column("text"))
            kind, slot, count = words_.look(token)
            log = model.steps(words_, contexts(token, place), kind, slot) / np.log(10)
            held = count >= 0
            own = np.where(held, np.log10(count + 0.5, where=held, out=np.zeros(len(count))), 0.0)
            sums = lambda x: np.add.reduceat(x, place[:-1])  # noqa: E731  every row has its end
            n = np.diff(place)
            row = batch.column("row").to_numpy()
            yield rows(
                part=(mix(row.astype(np.uint64)) % np.uint64(parts)).astype(np.int32), row=row, id=batch.column("id"), held_out=batch.column("held_out"),
                n_tokens=n, n_known=sums(held.astype(np.int64)), base_score=sums(own) - n * size_all, score=sums(log + own - size_of[kind, slot]),
            )
            at = np.flatnonzero(~held)
            if len(at):
                pair = np.stack([token[at], np.repeat(row, n)[at].view(np.uint64)])
                order = np.lexsort(pair[::-1])
                pair = pair[:, order]
                first = np.flatnonzero(np.append(True, (pair[:, 1:] != pair[:, :-1]).any(axis=0)))
                keys.append(pair[0, first])
                numbers.append(pair[1, first])
                times.append(np.diff(np.append(first, len(at))))
                if sum(map(len, keys)) > FLUSH:
                    part, blob = packed(parts, np.concatenate(keys), np.concatenate(keys), np.concatenate(numbers), np.concatenate(times))
                    yield rows(part=part, tails=blob)
                    keys, numbers, times = [], [], []
        if keys:
            part, blob = packed(parts, np.concatenate(keys), np.concatenate(keys), np.concatenate(numbers), np.concatenate(times))
            yield rows(part=part, tails=blob)

    def blobs(batches: Iterator[pa.RecordBatch], column: str, other: list) -> Iterator[bytes]:
        for batch in batches:
            c = batch.column(column)
            yield from c.drop_null().to_pylist()
            rest = batch.filter(c.is_null())
            if rest.num_rows:
                other.append(rest)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list = []
        tails = np.frombuffer(b"".join(blobs(batches, "tails", whole)), np.int64).reshape(-1, 3)
        sizes = []
        for batch in whole:
            c = batch.column("words")
            sizes += c.drop_null().to_pylist()
            rest = batch.filter(c.is_null())
            if rest.num_rows:
                yield rest
        if not len(tails):
            return
        pairs = np.frombuffer(b"".join(sizes), np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0].view(np.uint64))
        h, n = pairs[order, 0].view(np.uint64), pairs[order, 1]
        at = np.minimum(np.searchsorted(h, tails[:, 0].view(np.uint64)), max(0, len(h) - 1))
        count = np.where(h[at] == tails[:, 0].view(np.uint64), n[at], 0) if len(h) else np.zeros(len(tails), np.int64)
        row, inverse = np.unique(tails[:, 1], return_inverse=True)
        logs = np.bincount(inverse, weights=tails[:, 2] * np.log10(count + 0.5))
        seen = np.bincount(inverse, weights=tails[:, 2] * (count > 0)).astype(np.int64)
        bucket = mix(row.astype(np.uint64)) % np.uint64(parts)
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(parts + 1))
        table_ = np.stack([row, seen, logs.view(np.int64)], axis=1)[by]
        full = np.flatnonzero(np.diff(cut))
        yield rows(part=full.astype(np.int32), tails=[table_[cut[p] : cut[p + 1]].tobytes() for p in full])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list = []
        tails = np.frombuffer(b"".join(blobs(batches, "tails", whole)), np.int64).reshape(-1, 3)
        row, inverse = np.unique(tails[:, 0], return_inverse=True)
        seen = np.bincount(inverse, weights=tails[:, 1], minlength=len(row)).astype(np.int64)
        logs = np.bincount(inverse, weights=tails[:, 2].copy().view(np.float64), minlength=len(row))
        for batch in whole:
            own = batch.column("row").to_numpy()
            at = np.minimum(np.searchsorted(row, own), max(0, len(row) - 1))
            held = row[at] == own if len(row) else np.zeros(len(own), bool)
            more, log = (np.where(held, x[at], 0) if len(row) else np.zeros(len(own), x.dtype) for x in (seen, logs))
            yield rows(**{c: batch.column(c) for c in ("part", "row", "id", "held_out", "n_tokens")}, n_known=batch.column("n_known").to_numpy() + more, base_score=batch.column("base_score").to_numpy() + log, score=batch.column("score").to_numpy() + log)

    first = numbered.select("row", "id", "held_out", "text").mapInArrow(tidy(score), schema)
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in ("part", "words")]
    shares = counts.where("words is not null").select("part", "words", *blank).select(*schema.names)
    met = first.union(shares).repartition(parts, "part").mapInArrow(tidy(join), schema).repartition(parts, "part").mapInArrow(tidy(finish), schema)
    return met.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """The scores of every document, learned from all outside fold 1. See ``scored`` for nulls and repeats."""
    return scored(table(spark, sf_dir, "documents"))

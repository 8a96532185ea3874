"""SentencePiece encoding and decoding of whole batches by suffix-array matching.

A batch's distinct chunks are written end to end and their suffix array is sorted to the length of the longest piece.
Every piece is binary-searched, all in step, which gives its occurrences as a range of the array: the edges of the
segmentation graph. Edges are sorted by where they end and relaxed from left to right, all chunks in step.

The models here are byte-pair ones: pieces merge best score first, so the result is not the path of least cost. It is the
only path whose neighbouring pieces all stay apart when merged as a pair, and each prefix of a text has one last piece.
An edge therefore relaxes its end if it may follow the last piece at its start; the longest that may is the last piece.

Texts are cut into chunks wherever two characters meet that meet inside no piece: no piece crosses such a place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiquarry.llm.decontaminate import ranges, suffix_array
from lumiquarry.llm.textbytes import Memo, distinct, pieces, spread, tidy, utf8
from lumiquarry.session import table

SPACE = "▁"
#: Distinct chunks whose ids a worker remembers at most.
REMEMBER = 400_000


class Codec:
    """The tables of one model. Symbols are numbered by rank: characters first, then pieces of several, best score first."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for probe in ("a  b", " a ", "Åﬁ　\t"):
            if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
                raise ValueError("only models that leave texts as they are, but for a blank before, are supported")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = {i: sp.id_to_piece(i) for i in plain}
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.runs = {len(p) for p in text.values() if set(p) == {SPACE} and len(p) > 1}
        many = sorted((i for i in plain if len(text[i]) > 1 and set(text[i]) != {SPACE}), key=lambda i: (-sp.get_score(i), i))
        if any(SPACE in text[i][1:] for i in many):
            raise ValueError("only models whose pieces hold no blank but a first one are supported")
        single = {text[i]: i for i in plain if len(text[i]) == 1}
        chars = sorted({c for i in many for c in text[i]} | set(single))
        self.run_id = {len(p): i for i, p in text.items() if set(p) == {SPACE}}
        #: Model's id of each symbol; a character without a piece of its own has a number beyond, whose ids are bytes.
        symbol = [*chars, *(text[i] for i in many)]
        self.id_of = [single[c] if c in single else n + ord(c) for c in chars] + many
        rank = {p: r for r, p in enumerate(symbol)}
        base = len(chars)
        left, right, ok = np.full(len(symbol), -1), np.full(len(symbol), -1), np.ones(len(symbol), bool)
        key, to = [], []
        for r in range(base, len(symbol)):
            p = symbol[r]
            for k in range(1, len(p)):
                if p[:k] in rank and p[k:] in rank:
                    key.append(rank[p[:k]] * len(symbol) + rank[p[k:]])
                    to.append(r)
            parts = self._merge([rank[c] for c in p], symbol, rank, r)
            ok[r] = len(parts) == 2 and symbol[parts[0]] + symbol[parts[1]] == p
            if ok[r]:
                left[r], right[r] = parts
        order = np.argsort(key)
        self.key, self.to = np.array(key, np.int64)[order], np.array(to, np.int64)[order]
        self.left, self.right, self.base, self.n = left, right, base, len(symbol)
        self.length = np.array([len(p) for p in symbol], np.int64)
        self.longest = int(self.length.max())
        #: Character numbers, 0 for none, by code point; which two may meet inside a piece.
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(1, base + 1)
        self.meet = np.zeros((base + 1, base + 1), bool)
        for i in many:
            p = text[i]
            for a, b in zip(p[:-1], p[1:], strict=True):
                self.meet[rank[a] + 1, rank[b] + 1] = True
        self.searched = np.flatnonzero(ok)
        self.queries = np.zeros((len(self.searched), self.longest), np.int64)
        for k, r in enumerate(self.searched):
            self.queries[k, : self.length[r]] = [rank[c] + 1 for c in symbol[r]]
        self.blank = single.get(SPACE, -1)
        self.ids = np.array(self.id_of, np.int64)
        self.size = n
        # For decoding: the bytes of every id.
        raw = [text[i].replace(SPACE, " ").encode() if i in text else b"" for i in range(n)]
        for b, i in enumerate(self.byte):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.memo = Memo(REMEMBER)
        self.flat, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    @staticmethod
    def _merge(parts: list[int], symbol: list[str], rank: dict[str, int], below: int) -> list[int]:
        """What is left when the symbols merge, best first and leftmost first, by ranks less than ``below``."""
        while len(parts) > 1:
            best = min(((rank.get(symbol[a] + symbol[b], below), k) for k, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True))), default=(below, 0))
            if best[0] >= below:
                break
            parts = [*parts[: best[1]], best[0], *parts[best[1] + 2 :]]
        return parts

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether symbols a and b stay apart side by side.

        They do not if, while both were made, a part at the end of a and a part at the start of b would have merged before
        either went into its next larger part. Parts are undone latest first; what merges equally soon merges leftmost.
        """
        out = np.ones(len(a), bool)
        live, x, y, limit = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            joins = (self.key[at] == key) & (self.to[at] < limit)
            out[live[joins]] = False
            first = x > y
            go = ~joins & (np.where(first, x, y) >= self.base)
            live, x, y, limit, first = live[go], x[go], y[go], limit[go], first[go]
            limit = np.where(first, x, y + 1)
            x, y = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return out

    def segment(self, code: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of chunks of character numbers, end to end, and how many each has."""
        n = ends - begins
        start = np.cumsum(n + 1) - n - 1  # a 0 ends each chunk
        seq = np.zeros(int((n + 1).sum()), np.int64)
        seq[spread(start, n)] = code[spread(begins, n)]
        order = suffix_array(seq, self.longest)
        lo, hi = ranges(order, seq, self.queries, self.length[self.searched])
        at, piece = order[spread(lo, hi - lo)], np.repeat(self.searched, hi - lo)
        end = at + self.length[piece]
        by = np.argsort(end * 64 + (63 - np.minimum(self.length[piece], 63)), kind="stable")
        at, piece, end = at[by], piece[by], end[by]
        edge = np.searchsorted(end, np.arange(len(seq) + 1))
        last = np.full(len(seq) + 1, -1)  # the last symbol of the chunk's part before each place
        alive = np.argsort(-n, kind="stable")
        for p in range(1, int(n.max(initial=0)) + 1):
            alive = alive[: np.searchsorted(-n[alive], -p, "right")]
            place = start[alive] + p
            e, open_ = edge[place], np.arange(len(alive))
            while len(open_):
                s, t = at[e[open_]], piece[e[open_]]
                good = s == start[alive[open_]]
                test = np.flatnonzero(~good)
                good[test] = self.apart(last[s[test]], t[test])
                last[place[open_[good]]] = t[good]
                open_ = open_[~good]
                e[open_] += 1
        steps, place, rows = [], start + n, np.flatnonzero(n > 0)
        while len(rows):
            t = last[place[rows]]
            steps.append((rows, t))
            place[rows] -= self.length[t]
            rows = rows[place[rows] > start[rows]]
        if not steps:
            return np.zeros(0, np.int64), np.zeros(len(n), np.int64)
        row = np.concatenate([r for r, _ in steps])
        depth = np.repeat(np.arange(len(steps)), [len(r) for r, _ in steps])
        by = np.lexsort((-depth, row))
        return np.concatenate([t for _, t in steps])[by], np.bincount(row, minlength=len(n))

    def _fresh(self, cp: np.ndarray, code: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of chunks; characters without a piece become the ids of their bytes."""
        known = code[begins] > 0  # a character of no piece is a chunk of its own
        ids, count = np.zeros(0, np.int64), np.ones(len(begins), np.int64)
        symbols, count[known] = self.segment(code, begins[known], ends[known])
        row = np.repeat(np.flatnonzero(known), count[known])
        ids = np.concatenate([self.ids[symbols], self.size + cp[begins[~known]].astype(np.int64)])
        by = np.argsort(np.concatenate([row, np.flatnonzero(~known)]), kind="stable")
        ids = ids[by]
        if (ids >= self.size).any():
            rows, out, at = np.repeat(np.arange(len(count)), count), [], 0
            more = np.ones(len(ids), np.int64)
            for k in np.flatnonzero(ids >= self.size):
                raw = self.byte[np.frombuffer(chr(ids[k] - self.size).encode(), np.uint8)]
                out += [ids[at:k], raw.astype(np.int64)]
                more[k], at = len(raw), k + 1
            ids, count = np.concatenate([*out, ids[at:]]), np.bincount(rows, weights=more, minlength=len(count)).astype(np.int64)
        return ids, count

    @lru_cache(maxsize=4096)  # noqa: B019  one codec a worker
    def run(self, n: int) -> tuple[int, ...]:
        """The ids of n blanks: runs merge leftmost first as far as there is a piece, all with one score."""
        parts, more = [1] * n, True
        while more:
            more = False
            for k in range(len(parts) - 1):
                if parts[k] + parts[k + 1] in self.runs:
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                    more = True
                    break
        return tuple(self.run_id[p] for p in parts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        cp = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        code = self.char[cp]
        first = np.ones(len(cp), bool)
        first[1:] = ~self.meet[code[:-1], code[1:]]
        first[offsets[:-1][sizes > 0]] = True
        begins = np.flatnonzero(first)
        ends = np.append(begins[1:], len(cp))
        row = np.searchsorted(offsets, begins, "right") - 1
        raw, from_, to = cp.view(np.uint8), begins * 4, ends * 4
        seen, where, inverse = distinct(raw, from_, to)
        slot = self.memo.find(seen, raw, from_[where], to[where])
        new = np.flatnonzero(slot < 0)
        ids, count = self._fresh(cp, code, begins[where[new]], ends[where[new]]) if len(new) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        flat, counts = np.concatenate([self.flat, ids.astype(np.int32)]), np.concatenate([self.count, count])
        start = np.cumsum(counts) - counts
        slot[new] = len(self.count) + np.arange(len(new))
        if self.memo.add(seen[new], raw, from_[where[new]], to[where[new]]):
            self.flat, self.count = flat, counts
        slot = slot[inverse]
        size = counts[slot]
        out = flat[spread(start[slot], size)] if len(slot) else np.zeros(0, np.int32)
        total = np.bincount(row, weights=size, minlength=len(texts)).astype(np.int64)
        if self.runs:
            out, total = self._blanks(out, total)
        return out.astype(np.int32), total

    def _blanks(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of single blanks within a text become the pieces of their run."""
        b = ids == self.blank
        edge = np.zeros(len(ids) + 1, bool)
        edge[np.cumsum(count) - count] = True
        goes_on = b.copy()
        goes_on[1:] &= b[:-1]
        goes_on[:1] = False
        goes_on &= ~edge[:-1]
        heads = np.flatnonzero(b & ~goes_on)
        stop = np.flatnonzero(b & ~np.append(goes_on[1:], False)) + 1
        long = (stop - heads) > 1
        if not long.any():
            return ids, count
        row = np.repeat(np.arange(len(count)), count)
        out, at, more = [], 0, np.ones(len(ids), np.int64)
        for a, z in zip(heads[long].tolist(), stop[long].tolist(), strict=True):
            parts = self.run(z - a)
            out += [ids[at:a], np.array(parts, np.int32)]
            more[a:z] = 0
            more[a], at = len(parts), z
        return np.concatenate([*out, ids[at:]]), np.bincount(row, weights=more, minlength=len(count)).astype(np.int64)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of the texts, end to end, and how many each has, without the blank that encoding put first."""
        size = self.raw_size[ids]
        data = self.raw[spread(self.raw_at[ids], size)] if len(ids) else np.zeros(0, np.uint8)
        row = np.repeat(np.arange(len(count)), count)
        n = np.bincount(row, weights=size, minlength=len(count)).astype(np.int64)
        keep = np.ones(len(data), bool)
        at = (np.cumsum(n) - n)[n > 0]
        lead = at[data[at] == 32]
        keep[lead] = False
        n[np.searchsorted(np.cumsum(n), lead, "right")] -= 1
        return data[keep], n


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The tables of a model, made once a worker."""
    return Codec(path)


def encoded(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The pieces of whole texts: ``id_col``, columns ``keep``, tokens (array of ids), n_tokens, ids_crc32 and round_trip.

    ``model`` is the path of a SentencePiece byte-pair model on every machine. ids_crc32 is the unsigned CRC-32 of the ids
    as little-endian 32-bit integers; round_trip says whether decoding gives the text again, which fails for texts that
    hold the model's own mark for blanks. Null and empty texts have no ids. A row per row of ``docs``, in its partition;
    repeated rows are answered each; further columns are not read. Memory follows the longest text.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    schema = base.drop("text").select("*", F.lit(None).cast("array<int>").alias("tokens"), F.lit(0).alias("n_tokens"), F.lit(0).cast("long").alias("ids_crc32"), F.lit(True).alias("round_trip")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(model)
        for batch in pieces(batches, "text"):
            column = batch.column("text")
            ids, count = tables.encode([t or "" for t in column.to_pylist()])
            data, n = tables.decode(ids, count)
            old, offsets = utf8(column)
            same = n == np.diff(offsets)
            if same.all():
                full = np.flatnonzero(n)
                if len(full):
                    same[full] = np.logical_and.reduceat(data == old, offsets[full])
            else:
                cut = np.cumsum(n)
                same = np.array([s and bytes(data[c - k : c]) == bytes(old[a : a + k]) for s, c, k, a in zip(same, cut, n, offsets[:-1], strict=True)])
            ends = np.cumsum(count)
            crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(ends, count, strict=True)]
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, tokens, pa.array(count.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(same)], names=schema.names)

    if {*keep} & {id_col, "tokens", "n_tokens", "ids_crc32", "round_trip"}:
        raise ValueError("a kept column has the name of a result")
    names = [F.col("id").alias(id_col), *[F.col(f"kept_{c}").alias(c) for c in keep]]
    return base.mapInArrow(tidy(run), schema).select(*names, "tokens", "n_tokens", "ids_crc32", "round_trip")


def op5_sentencepiece_codec(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and round_trip of every document. Null texts are empty: no ids."""
    import public_tokenizers

    out = encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32", "round_trip")

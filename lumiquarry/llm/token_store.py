"""Token ids on disk: ORC files in document order.

Texts are dealt out by ranges of the id and sorted, encoded task by task, and written as ORC: the ids of a document are
one integer list, which ORC run-length encodes; row indexes every ``stride`` rows and a Bloom filter on the document id
let a reader skip stripes and row groups from metadata alone, and stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumiquarry.llm.textbytes import Memo, distinct, pieces, spread, tidy, utf8
from lumiquarry.session import shared_folder, table

#: Distinct chunks whose ids a worker remembers at most.
REMEMBER = 800_000
ORC = {"orc.compress": "ZSTD", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true"}
#: Bytes that a plain text does not hold: controls but the line end, and what leads characters beyond U+024F or below U+00C0.
ODD = np.ones(256, bool)
ODD[10] = ODD[32:127] = ODD[0x80:0xC0] = ODD[0xC3:0xCA] = False
BLANK = np.zeros(256, bool)
BLANK[[10, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


class Encoder:
    """The tokenizers library's ids of texts, with the ids of chunks that recur remembered by their bytes.

    A plain text holds ASCII, line ends and Latin letters up to U+024F alone, which byte-level patterns class alike
    everywhere. Such a pattern never joins a letter with what is none after it, nor a character that is no white space
    with white space after it. The text's ids are those of its chunks between these places, end to end. Any other text,
    and one that holds an added token, is encoded as it stands. New chunks of a blank and a word are encoded in one text,
    each after a line end, which is a token of its own there.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        self.encode = model.encode_batch_fast
        self.added = [t.content.encode() for t in model.get_added_tokens_decoder().values()]
        self.line = self._ids(["\n"])[0]
        self.plain = "ByteLevel" in type(model.pre_tokenizer).__name__ and model.normalizer is None and len(self.line) == 1
        self.memo = Memo(REMEMBER)
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.encode(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunks in another order, which comes last: first their ids end to end, and how many each has."""
        lined = np.fromiter((c[0] == " " and c[-1] not in " \n" and "\n" not in c for c in chunks), bool, len(chunks))
        order = np.argsort(~lined, kind="stable")
        words, rest = [chunks[k] for k in order[: lined.sum()]], [chunks[k] for k in order[lined.sum() :]]
        flat, size = [], []
        for k in range(0, len(words), 4096):
            (ids,) = self._ids(["\n" + "\n".join(words[k : k + 4096])])
            cut = np.flatnonzero(ids == self.line[0])
            if len(cut) != len(words[k : k + 4096]):
                raise ValueError("a line end is no token of its own")
            flat.append(np.delete(ids, cut))
            size.append(np.diff(np.append(cut, len(ids))) - 1)
        own = self._ids(rest)
        return np.concatenate([np.zeros(0, np.int32), *flat, *own]), np.concatenate([np.zeros(0, np.int64), *size, np.fromiter(map(len, own), np.int64, len(own))]), order

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        data, offsets = utf8(column)
        odd = ODD[data]
        for lead, low, high in ((0xC3, 0x97, 0x97), (0xC3, 0xB7, 0xB7), (0xC9, 0x90, 0xBF)):  # signs among the letters, letters beyond U+024F
            at = np.flatnonzero(data[:-1] == lead)
            odd[at] |= (data[at + 1] >= low) & (data[at + 1] <= high)
        n = np.diff(offsets)
        rough = np.zeros(len(n), bool)
        full = np.flatnonzero(n)
        if len(full):
            rough[full] = np.logical_or.reduceat(odd, offsets[full]) if self.plain else True
        for mark in self.added:
            raw, at = data.tobytes(), -1
            while (at := raw.find(mark, at + 1)) >= 0:
                rough[np.searchsorted(offsets, at, "right") - 1] = True
        blank = BLANK[data]
        first = np.zeros(len(data), bool)
        first[1:] = blank[1:] & ~blank[:-1]
        letter = LETTER[data]
        first[1:] |= letter[:-1] & ~letter[1:]
        first[offsets[:-1][n > 0]] = True
        begins = np.flatnonzero(first)
        ends = np.append(begins[1:], len(data))
        row = np.searchsorted(offsets, begins, "right") - 1
        if rough.any():
            begins, ends, row = (x[~rough[row]] for x in (begins, ends, row))
        seen, where, inverse = distinct(data, begins, ends)
        slot = self.memo.find(seen, data, begins[where], ends[where])
        new = np.flatnonzero(slot < 0)
        raw = data.tobytes()
        ids, size, order = self._chunks([raw[a:b].decode() for a, b in zip(begins[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        flat, sizes = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])
        start = np.cumsum(sizes) - sizes
        new = new[order]
        slot[new] = len(self.size) + np.arange(len(new))
        if self.memo.add(seen[new], data, begins[where[new]], ends[where[new]]):
            self.flat, self.size = flat, sizes
        slot = slot[inverse]
        size = sizes[slot]
        ids = flat[spread(start[slot], size)] if len(slot) else np.zeros(0, np.int32)
        count = np.bincount(row, weights=size, minlength=len(n)).astype(np.int64)
        if not rough.any():
            return ids, count
        whole = dict(zip(np.flatnonzero(rough).tolist(), self._ids([column[int(i)].as_py() for i in np.flatnonzero(rough)]), strict=True))
        cut = np.cumsum(count)
        rows = [whole[i] if i in whole else ids[cut[i] - count[i] : cut[i]] for i in range(len(n))]
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """One for all tasks of a worker, so that what it remembers serves them all."""
    return Encoder(path)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, stripe_bytes: int = 64 << 20, stride: int = 1000) -> None:
    """Encodes whole texts and writes ``path``: ORC files of (doc_id, part, at, n_tokens, tokens), ascending by doc_id through parts.

    ``tokenizer`` is the path of a tokenizers file on every machine. ``end_id`` follows each document. ``part`` numbers the
    ranges of ids and ``at`` counts the tokens of a part before the document. Null texts are empty; null ids come first;
    rows that share an id follow each other in an order by a hash of the text; an empty table writes no rows; further
    columns are not read. Where a third of the rows share one id, that hash deals them out to several ranges.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").withColumn("part", F.spark_partition_id())
    schema = "doc_id long, part int, at long, n_tokens long, tokens array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, at = worker_encoder(tokenizer), 0
        for batch in pieces(batches, "text"):
            ids, count = encoder.batch(batch.column("text"))
            rows = np.arange(len(count))
            n = count + 1
            ends = np.cumsum(n)
            out = np.full(ends[-1], end_id, np.int32)
            out[np.arange(len(ids)) + np.repeat(rows, count)] = ids
            places = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(at + ends - n), pa.array(n), pa.ListArray.from_arrays(places, pa.array(out))], names=["doc_id", "part", "at", "n_tokens", "tokens"])
            at += int(ends[-1])

    encoded = dealt.select("doc_id", "text", "part").mapInArrow(tidy(run), schema)
    encoded.write.options(**ORC, **{"orc.stripe.size": str(stripe_bytes), "orc.row.index.stride": str(stride)}).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of what ``write_tokens`` wrote; start counts the tokens of all documents before it.

    Filters on doc_id reach ORC's statistics and Bloom filters. The totals of the parts, one row a file, are all that is
    summed up in one place.
    """
    stored = spark.read.schema("doc_id long, part int, at long, n_tokens long, tokens array<int>").orc(path)
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return stored.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "tokens")


def with_crc32(tokens: DataFrame) -> DataFrame:
    """The columns of ``tokens`` but the ids, with ids_crc32: the unsigned CRC-32 of the ids as little-endian 32-bit integers."""
    rest = [c for c in tokens.columns if c != "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("tokens")
            places = ids.offsets.to_numpy()
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
            crc = [zlib.crc32(flat[a:b].data) for a, b in zip(places[:-1], places[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(crc, pa.int64())], names=[*rest, "ids_crc32"])

    return tokens.mapInArrow(tidy(run), tokens.select(*rest, F.lit(0).cast("long").alias("ids_crc32")).schema)


def op4_token_id_binary_output(spark, sf_dir: str) -> DataFrame:
    """Every document's ids through ORC files and back: doc_id, start, n_tokens, ids_crc32. Null texts are empty: the end id alone."""
    import public_tokenizers

    path = shared_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return with_crc32(read_tokens(spark, path))

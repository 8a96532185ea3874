"""Quality classifier: supervised subword embeddings.

A text's features are its words, its pairs of neighbouring words, and its runs of three and four characters, case kept
and white space included, each hashed to one of 2**BITS learned vectors. The hash of a pair is the exclusive or of its
words' hashes, so that pairs of equal words, whatever the word, share a vector. A document is the average of its features'
vectors; a softmax over two classes reads it. Training is stochastic gradient descent in numpy, one document a step, in a
single task on a bounded sample of labelled rows. As the average and the logit are linear, the trained vectors fold into
one number a bucket, which is all that is broadcast (1 MB whatever the input) to score whole texts where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiquarry.llm.textbytes import M1, M2, NOT_SPACE, STEP, hashes, pieces, spread, tidy, utf8, words
from lumiquarry.session import table

BITS, DIM = 18, 8
SHIFT = np.uint64(64 - BITS)
#: Labelled rows that training takes at most: the first by a hash of the id.
SAMPLE = 8000
#: Bytes of their features that it takes at most, in the order of that hash.
SAMPLE_BYTES = 512 << 20
EPOCHS, RATE = 6, 4.0


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows end to end, as 64-bit numbers, and the n + 1 places where rows begin."""
    if not len(data) or data.max() < 128:
        return data.astype(np.uint64), offsets
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=place[1:])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64), place[offsets]


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words, pairs of words, 3- and 4-character runs: the buckets of all rows end to end, and the n + 1 places where rows begin."""

    def kind(hash_: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of runs of ``size``: ``hash_`` has one for each place, of which the last of a row are of no run."""
        count = np.maximum(np.diff(begins) - size + 1, 0)
        return (hash_ >> SHIFT).astype(np.uint32)[spread(begins[:-1], count)], np.concatenate([[0], np.cumsum(count)])

    begins, ends, first = words(data, offsets, NOT_SPACE)
    word = hashes(data, begins, ends)
    pair = word.copy()
    pair[:-1] ^= word[1:]
    out = [kind(word, first, 1), kind(pair, first, 2)]
    x, place = characters(data, offsets)
    run = x.copy()  # 21 bits a character
    for k in (1, 2):
        run[:-k] |= x[k:] << np.uint64(21 * k)
    out.append(kind(run * STEP, place, 3))
    run *= M1
    run[:-3] += x[3:] * M2
    run ^= run >> np.uint64(29)
    out.append(kind(run * STEP, place, 4))
    return out


def counted(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row's distinct buckets and what part of its features falls in each."""
    data, offsets = utf8(batch.column("text"))
    kinds = features(data, offsets)
    for i in range(batch.num_rows):
        own = np.concatenate([b[p[i] : p[i + 1]] for b, p in kinds])
        bucket, count = np.unique(own, return_counts=True)
        yield bucket, (count / max(1, len(own))).astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """The weight of each bucket in the logit of label 1, and the bias.

    Steps shrink with the squares of past gradients, summed over all buckets, so that what many documents share is learned first; of one class only, the answer is its smoothed share.
    """
    share = (label.sum() + 0.5) / (len(label) + 1)
    bias = np.array([0.0, np.log(share / (1 - share))], np.float32)
    if not 0 < label.sum() < len(label):
        return np.zeros(1 << BITS, np.float32), float(bias[1] - bias[0])
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out = rng.uniform(-1, 1, (2, DIM)).astype(np.float32)
    past, past_out, past_bias = 1e-6, 1e-4, 1e-2
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            bucket, part = rows[i]
            held = vectors[bucket]
            mean = part @ held
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[int(label[i])] -= 1
            back = p @ out
            step = np.outer(part, back)
            past += float((step * step).sum())
            vectors[bucket] = held - RATE * step / np.sqrt(past)
            grad = np.outer(p, mean)
            past_out += float((grad * grad).mean())
            out -= RATE / 10 * grad / np.sqrt(past_out)
            past_bias += float((p * p).mean())
            bias -= RATE / 10 * p / np.sqrt(past_bias)
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def fold(id_: Column) -> Column:
    """Which of five folds a row is in; null for a null id."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model of ``label_col`` from at most ``sample`` labelled ids and SAMPLE_BYTES of their features, all outside fold 0.

    An id with several labels has the one that most of its rows say, 0 on a tie; rows with a null id or label are out.
    Without any usable row every text scores 0.5.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 0))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) > 0.5).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            got = list(counted(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("label"), pa.array([b.tobytes() for b, _ in got], pa.binary()), pa.array([p.tobytes() for _, p in got], pa.binary())], names=["id", "label", "buckets", "parts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("id", "buckets", "parts", "label")), strict=True):
                size += len(row[1]) + len(row[2])
                if size <= SAMPLE_BYTES or not got:
                    got.append(row)
        if not got:
            return
        got.sort()
        weights, bias = train([(np.frombuffer(b, np.uint32), np.frombuffer(p, np.float32)) for _, b, p, _ in got], np.array([x[3] for x in got]))
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])

    one = rows.mapInArrow(tidy(count), "id string, label int, buckets binary, parts binary").repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(tidy(learn), "weights binary, bias double").first()
    return (np.frombuffer(one["weights"], np.float32), one["bias"]) if one else (np.zeros(1 << BITS, np.float32), 0.0)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: the probability of label 1 from the whole text. Null and empty texts score the bias alone.

    A column of ``docs`` that is named so is replaced; repeated rows are answered each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_col)
    schema = docs.select("*", F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in pieces(batches, text_col):
            data, offsets = utf8(batch.column(text_col))
            total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for bucket, place in features(data, offsets):
                n = np.diff(place)
                full = np.flatnonzero(n)
                if len(full):
                    total[full] += np.add.reduceat(weights[bucket], place[full], dtype=np.float64)
                count += n
            z = np.clip(total / np.maximum(count, 1) + bias, -30, 30)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned outside fold 0. A null or empty text scores the bias; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

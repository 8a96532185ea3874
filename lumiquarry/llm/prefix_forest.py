"""Approximate nearest neighbours by inner product: a forest of sorted hash prefixes (LSH Forest).

The rows are dealt into shards of about SHARD vectors. A shard has TREES sorted arrays of 64-bit hash strings, each bit
the side of a random hyperplane. A query descends every tree to its longest matching prefixes and then ascends all trees
in step, one bit at a time. The rows under the prefixes are scored exactly in double precision. It stops where a row as
near as the k-th best found would be under none of the prefixes with a chance of MISS at most: at angle A two strings
agree in a bit with p = 1 - A/pi, so that chance is (1 - p**bits)**TREES. The k-th best is that of all shards: a first
pass scores the rows under the longest prefixes of every shard, and the second stops by the best of those. Near neighbours end the ascent after few rows;
where all rows are about equally far, as in random vectors, no short list holds the nearest, and it goes on to many.
Vectors of different lengths are lifted to one length first, so that the angle orders rows as the inner product does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiquarry.llm.textbytes import spread
from lumiquarry.session import table, written

SHARD, TREES = 8192, 64
#: The chance to miss a neighbour at which a query stops ascending, and the rows for each asked for from which it tests that.
MISS, FIRST = 0.1, 16
#: Queries, and bytes of their vectors, that are broadcast at once; queries that a task works on together.
QUERIES, QUERY_BYTES, TOGETHER = 16384, 32 << 20, 1024


def planes(dim: int) -> np.ndarray:
    return np.random.default_rng(20_240_607).standard_normal((dim + 1, TREES * 64)).astype(np.float32)


def unit(vectors: np.ndarray, whole: bool = False) -> np.ndarray:
    """The vectors by their own lengths or, ``whole``, all by that of the longest; none overflows on the way."""
    v = vectors / (np.abs(vectors).max(initial=1e-300) if whole else np.abs(vectors).max(axis=1, keepdims=True, initial=1e-300))
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return (v / (size.max(initial=1e-300) if whole else np.maximum(size, 1e-300))).astype(np.float32)


def length(vectors: np.ndarray) -> np.ndarray:
    """The vectors' lengths, by way of their greatest components, so that none overflows."""
    most = np.abs(vectors).max(axis=1, initial=1e-300)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1))


def strings(vectors: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The hash strings of each vector in each tree: (rows, TREES) of 64 bits, the first plane the highest."""
    bits = vectors.astype(np.float32) @ side > 0
    return np.packbits(bits.reshape(len(vectors), TREES, 64), axis=2).view(">u8")[:, :, 0].astype(np.uint64)


class Forest:
    """The trees of one shard: sorted strings and the rows in that order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        v = unit(vectors, whole=True)
        lift = np.sqrt(np.maximum(1 - (v * v).sum(axis=1, keepdims=True), 0))
        keys = strings(np.concatenate([v, lift], axis=1), planes(vectors.shape[1]))
        self.order = np.argsort(keys, axis=0, kind="stable").T.astype(np.int32)
        self.keys = np.take_along_axis(keys.T, self.order.astype(np.int64), axis=1)

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(x).tobytes() for x in (self.ids, self.vectors, self.order, self.keys)]

    @classmethod
    def unpacked(cls, ids: bytes, vectors: bytes, order: bytes, keys: bytes) -> Forest:
        out = cls.__new__(cls)
        out.ids = np.frombuffer(ids, np.int64)
        n = len(out.ids)
        out.vectors = np.frombuffer(vectors, np.float64).reshape(n, -1)
        out.order = np.frombuffer(order, np.int32).reshape(TREES, n)
        out.keys = np.frombuffer(keys, np.uint64).reshape(TREES, n)
        return out

    def ranges(self, hashed: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in each tree the rows lie that share the first ``level`` bits of each query's strings (TREES, queries)."""
        low = np.where(level > 0, (np.uint64(1) << (64 - np.maximum(level, 1)).astype(np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
        a, b = np.empty(hashed.shape, np.int64), np.empty(hashed.shape, np.int64)
        for t in range(TREES):
            a[t], b[t] = np.searchsorted(self.keys[t], hashed[t] & ~low), np.searchsorted(self.keys[t], hashed[t] | low, "right")
        return a, b

    def descended(self, hashed: np.ndarray, enough: int) -> np.ndarray:
        """The longest prefix of each query that ``enough`` rows share, counted over the trees; 0 where there are too few."""
        lo, hi = np.zeros(hashed.shape[1], np.int64), np.full(hashed.shape[1], 64)
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) >> 1
            a, b = self.ranges(hashed, mid)
            ok = (b - a).sum(axis=0) >= enough
            lo, hi = np.where(open_ & ok, mid, lo), np.where(open_ & ~ok, mid - 1, hi)
        return lo

    def nearest(self, ids: np.ndarray, vectors: np.ndarray, hashed: np.ndarray, k: int, floor: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its k best candidates, without the row of its own id.

        ``floor`` has the k-th best score known of each query, -inf without one. Without ``floor`` nothing ascends.
        """
        for at in range(0, len(ids), TOGETHER):
            to = at + TOGETHER
            yield from self._nearest(ids[at:to], vectors[at:to], hashed[:, at:to], k, None if floor is None else floor[at:to])

    def _nearest(self, ids: np.ndarray, vectors: np.ndarray, hashed: np.ndarray, k: int, floor: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        n, flat, first = len(self.ids), self.order.ravel(), np.arange(TREES) * len(self.ids)
        # To stop by, scores are against the longest row, so those of rough are cosines after lifting; what counts is scored in double precision.
        rough, asked = unit(self.vectors, whole=True), unit(vectors)
        unseen = self.ids[None, :] != ids[:, None]
        rows, scores = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0, np.float32)] * len(ids)
        level, live = self.descended(hashed, FIRST * k), np.arange(len(ids))
        known = np.full(len(ids), np.inf) if floor is None else floor / (length(vectors) * length(self.vectors).max())
        while len(live):
            lo, hi = self.ranges(hashed[:, live], level[live])
            kth = np.full(len(live), -np.inf)
            for x, q in enumerate(live):
                new = np.zeros(n, bool)
                new[flat[spread(first + lo[:, x], hi[:, x] - lo[:, x])]] = True
                new &= unseen[q]
                at = np.flatnonzero(new)
                unseen[q, at] = False
                # Rows about as near as the k-th stay in until exact scores and ids decide.
                at, score = np.concatenate([rows[q], at]), np.concatenate([scores[q], rough.take(at, axis=0) @ asked[q]])
                if len(at) >= k:
                    kth[x] = np.partition(score, len(score) - k)[len(score) - k]
                    near = score >= kth[x] - 1e-5
                    at, score = at[near], score[near]
                rows[q], scores[q] = at, score
            kth = np.maximum(kth, known[live])
            same = 1 - np.arccos(np.clip(kth, -1, 1)) / np.pi
            with np.errstate(divide="ignore"):
                done = (level[live] == 0) | ((kth > -np.inf) & (TREES * np.log1p(-(same ** level[live])) <= np.log(MISS)))
            live = live[~done]
            level[live] -= 1
        out = []
        for q, at in enumerate(rows):
            score = (self.vectors[at] * vectors[q]).sum(axis=1)
            best = np.lexsort((self.ids[at], -score))[:k]
            out.append((self.ids[at[best]], score[best]))
        return out


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for each query: query_id, rank (from 1), ``id_col``, score, by largest inner product.

    Both tables have ``id_col`` and ``vector_col``. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, nor do rows with a null id or a length other than the commonest (the least of the commonest).
    Rows of a table that share an id are one, with the least vector. A query's own id is no candidate; ties go to the
    smaller id; with fewer than ``k`` candidates all are returned. An empty table gives no rows.

    Every row is indexed, in the shared folder. Queries go to the shards in blocks of QUERIES rows and QUERY_BYTES at most,
    each broadcast.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & good)

    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    dim, shards = sizes["dim"], -(-sizes["n"] // SHARD)
    one = lambda df: df.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        ids, shard = t["id"].to_numpy(), t["shard"].to_numpy()
        flat = t["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            own = own[np.argsort(ids[own])]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in Forest(ids[own], flat[own]).packed()], names=["ids", "vectors", "order", "keys"])

    dealt = one(rows).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    index = written(dealt.repartition(shards, "shard").mapInArrow(plant, "ids binary, vectors binary, order binary, keys binary"), "forest")
    asked = one(usable(queries))
    blocks = -(-asked.count() // max(1, min(QUERIES, QUERY_BYTES // (8 * dim))))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, blocks)))), "queries")

    def search(block: int) -> DataFrame:
        own = asked.where(F.col("block") == block).select("id", "v").orderBy("id").toArrow()
        ids = own["id"].to_numpy()
        sent = spark.sparkContext.broadcast((ids, own["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)))

        def run(batches: Iterator[pa.RecordBatch], floor=None) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            hashed = strings(np.concatenate([unit(vectors), np.zeros((len(ids), 1))], axis=1), planes(dim)).T.copy()
            for batch in batches:
                for row in range(batch.num_rows):
                    forest = Forest.unpacked(*(batch.column(c)[row].as_py() for c in ("ids", "vectors", "order", "keys")))
                    found = list(forest.nearest(ids, vectors, hashed, k, floor and floor.value))
                    n = [len(x) for x, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([x for x, _ in found]) if found else ids[:0]), pa.array(np.concatenate([x for _, x in found]) if found else np.zeros(0))], names=["query_id", "id", "score"])

        # A shard is some megabytes in one row: a task takes few.
        found, schema = index.repartition(min(shards, 4096)), "query_id long, id long, score double"
        first = found.mapInArrow(run, schema).withColumn("rank", rank).where(F.col("rank") <= k)
        kth = first.groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", "score").toArrow()
        floor = np.full(len(ids), -np.inf)
        floor[np.searchsorted(ids, kth["query_id"].to_numpy())] = kth["score"].to_numpy()
        bound = spark.sparkContext.broadcast(floor)
        return found.mapInArrow(lambda batches: run(batches, bound), schema)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = search(0)
    for block in range(1, blocks):
        found = written(found.union(search(block)), "nearest")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op7_approximate_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector, among all. See ``nearest_neighbours`` for what takes no part."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(rows, rows.where("vec_id % 20 = 0"))

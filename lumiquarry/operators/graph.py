"""Connected components of an edge list by local contraction and alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumiquarry.operators.joins import hub_join
from lumiquarry.session import written

#: Edges that a task gathers before it turns them into stars.
HELD = 1 << 20


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least of the numbers 0 to n - 1 that each reaches over the edges u[i] - v[i]: roots hang on lesser ones, then paths are halved."""
    up = np.arange(n)
    while True:
        a, b = up[u], up[v]
        live = a != b
        if not live.any():
            return up
        np.minimum.at(up, np.maximum(a, b)[live], np.minimum(a, b)[live])
        while ((far := up[up]) != up).any():
            up = far


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges (u, v) as stars: an edge from each node but the least of every component within the task. HELD edges are gathered, then turned into stars."""
    held, n = [], 0

    def stars() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        node, code = np.unique(np.concatenate([t["u"].to_numpy(), t["v"].to_numpy()]), return_inverse=True)
        up = roots(code[: t.num_rows], code[t.num_rows :], len(node))
        rest = np.flatnonzero(up != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[rest], t.schema.field("u").type), pa.array(node[up[rest]], t.schema.field("v").type)], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n > HELD + held[0].num_rows:
                held = [stars()]
                n = held[0].num_rows
    if held:
        yield stars()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, component): for every node of an edge between two different nodes, the smallest node it reaches.

    Each task first turns the edges it reads into stars, before any is shuffled. Then large-star hangs each larger neighbour on the smallest
    neighbour, small-star each smaller one; the trees flatten in about log(n) rounds. Minima are pre-aggregated before the
    shuffle and joined back by ``hub_join``: a node with more edges than a task's share is broadcast, so a hub's edges
    stay where they are read. Every half round is written to the shared folder. Null ends, loops and repeated edges add
    nothing; an empty edge list gives no rows.
    """

    def settled(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        e = e.select("u", "v").distinct()
        e = written(e.mapInArrow(contracted, e.schema).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "components")
        return e, (seen.get["n"], seen.get["sum"])

    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e, seen = settled(e.mapInArrow(contracted, e.schema))
    for _ in range(rounds):
        n = seen[0]
        if not n:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = hub_join(both.where(F.col("v") > F.col("u")), low, "u", "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hub_join(large, low, "u", "n", 2 * n).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = settled(small.union(low.select("u", F.col("m").alias("v"))))
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())

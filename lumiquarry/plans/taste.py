"""Learning from decisions, and calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiquarry.functions.scores import sigmoid, taste_weight
from lumiquarry.functions.vec import dot, unit
from lumiquarry.operators.aggregate import mean_vectors, rank_auc
from lumiquarry.session import written

# Steps, rate, penalty; labels needed in all and of each class; held-out share and its seed.
STEPS, RATE, PENALTY, LEAST, LEAST_EACH, SHARE, SEED = 500, 1.0, 0.01, 100, 10, 0.2, 1152


def labelled(embeddings: DataFrame, swipes: DataFrame) -> DataFrame:
    """(photo_id, v, y) of kept, silver and rejected photos that have a vector; v has length 1."""
    y = F.when(F.col("decision").isin("keep", "silver"), 1).when(F.col("decision") == "reject", 0)
    return embeddings.join(swipes.select("photo_id", y.alias("y")).where("y is not null"), "photo_id").select("photo_id", unit(F.col("embedding")).alias("v"), "y")


def gradient(rows: DataFrame, w: np.ndarray, b: float, weight: dict[int, float]) -> tuple[np.ndarray, float]:
    """The data part of the gradient, summed in the tasks: what comes back is one vector a partition."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(len(w) + 1)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                y = batch.column("y").to_numpy()
                z = x @ w + b
                e = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * np.where(y == 1, weight[1], weight[0])
                g += np.append(x.T @ e, e.sum())
        yield pa.RecordBatch.from_arrays([pa.array([g.tolist()], pa.list_(pa.float64()))], names=["g"])

    total = rows.mapInArrow(add, "g array<double>").select(F.posexplode("g").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
    g = np.array([r["x"] for r in total])
    return g[:-1], float(g[-1])


def train_taste(rows: DataFrame, *, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY, local_bytes: int = 64 << 20) -> tuple[np.ndarray, float]:
    """C11: weights and bias of a logistic regression by full gradient steps from zero, classes weighted alike, bias unpenalised.

    Labels are people's swipes, so they are few: up to ``local_bytes`` of vectors are taken to the driver; more are written
    to the shared folder once and each step is a distributed sum of gradients. Raises ValueError below 100 labels or 10 of
    a class.
    """
    count = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n = sum(count.values())
    if n < LEAST or min(count.get(0, 0), count.get(1, 0)) < LEAST_EACH:
        raise ValueError("too few labels")
    weight = {y: 1 / (2 * count[y]) for y in (0, 1)}  # all weights sum to 1
    local, w = None, np.zeros(rows.select(F.size("v")).first()[0])
    if n * len(w) * 8 <= local_bytes:
        got = rows.select("v", "y").toPandas()
        local = np.stack(got["v"]).astype(np.float64), got["y"].to_numpy()
    else:
        rows = written(rows.select("v", "y"), "labelled")
    b = 0.0
    for _ in range(steps):
        if local is not None:
            x, y = local
            e = (1 / (1 + np.exp(-np.clip(x @ w + b, -500, 500))) - y) * np.where(y == 1, weight[1], weight[0])
            gw, gb = x.T @ e, float(e.sum())
        else:
            gw, gb = gradient(rows, w, b, weight)
        w, b = w - rate * (gw + penalty * w), b - rate * gb
    return w, b


def held_out(rows: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """``rows`` with held_out: of each class the first ``share`` by a seeded hash of the id, rounded, one at least."""
    size = rows.groupBy("y").agg(F.greatest(F.lit(1), F.round(F.count("*") * share).cast("int")).alias("_k"))
    at = F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("photo_id", F.lit(seed)), "photo_id"))
    return rows.withColumn("_at", at).join(F.broadcast(size), "y").withColumn("held_out", F.col("_at") <= F.col("_k")).drop("_at", "_k")


def taste_report(rows: DataFrame, **how) -> DataFrame:
    """C11: one row (n_samples, auc, weight, w, b): the model of all labels, and the AUC that one without the held-out fifth of each class has on it.

    The saved model is this row, written by the caller as a table.
    """
    split = written(held_out(rows), "labelled")
    w, b = train_taste(split.where("not held_out"), **how)
    auc = rank_auc(split.where("held_out").withColumn("score", sigmoid(dot(F.col("v"), F.array(*[F.lit(float(x)) for x in w])) + b)), F.col("y") == 1, "score")
    w, b = train_taste(split, **how)
    n = split.agg(F.count("*").alias("n_samples"))
    return n.join(auc, F.lit(True)).select("n_samples", "auc", taste_weight(F.col("n_samples")).alias("weight"), F.array(*[F.lit(float(x)) for x in w]).alias("w"), F.lit(float(b)).alias("b"))


def taste_scores(embeddings: DataFrame, w: Sequence[float], b: float) -> DataFrame:
    """(photo_id, taste)."""
    return embeddings.select("photo_id", sigmoid(dot(unit(F.col("embedding")), F.array(*[F.lit(float(x)) for x in w])) + b).alias("taste"))


def retrained(embeddings: DataFrame, ratings: DataFrame, least: int = 3) -> DataFrame:
    """(photo_id, personal_score): the cosine of every photo with the mean of the liked ones (three at least, else no rows)."""
    liked = embeddings.join(ratings.where("rating = 1").select("photo_id"), "photo_id", "left_semi")
    centre = mean_vectors(liked.select(F.lit(0).alias("g"), unit(F.col("embedding")).alias("v")), ["g"], "v").where(F.col("n") >= least)
    return embeddings.join(F.broadcast(centre.select("centroid")), F.lit(True)).select("photo_id", dot(unit(F.col("embedding")), F.col("centroid")).alias("personal_score"))

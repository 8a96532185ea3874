"""Joins of vectors by angle: exact, and without the tiles that the triangle inequality keeps apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiquarry.operators import pivots
from lumiquarry.plans import dedup

SCHEMA = "library string, photo_id long, embedding array<double>, tile int, cell string"


def clustered(seed, n, clusters, dims, spread):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(clusters, dims))
    v = centre[r.integers(0, clusters, n)] + spread * r.normal(size=(n, dims))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def held(spark, v, library=lambda k: "a"):
    return spark.createDataFrame([(library(k), k, x.tolist(), None, None) for k, x in enumerate(v)], SCHEMA)


def brute(v, cut, library=lambda k: "a"):
    g = v @ v.T
    return {(a, b) for a, b in zip(*np.nonzero(g >= cut), strict=True) if a < b and library(a) == library(b)}


@pytest.fixture(params=[0, 4096], autouse=True)
def small(request, monkeypatch):
    """With pivots, and as small tables are dealt."""
    monkeypatch.setattr(pivots.near_rows, "__kwdefaults__", pivots.near_rows.__kwdefaults__ | {"small": request.param})


@pytest.mark.parametrize("dims,cut", [(3, 0.9), (12, 0.8), (40, 0.3)])
def test_pairs_are_all_pairs(spark, dims, cut):
    v = clustered(dims, 700, 12, dims, 0.25)
    library = lambda k: "ab"[int(k % 3 == 0)]
    got = dedup.near_pairs(held(spark, v, library), cut, by=["library"], most=None, block=64).collect()
    assert {(r["a"], r["b"]) for r in got} == brute(v, cut, library) and len(got) == len(brute(v, cut, library))
    assert all(abs(r["similarity"] - v[r["a"]] @ v[r["b"]]) < 1e-9 for r in got)


def test_tiles_far_apart_are_not_multiplied_and_rows_not_copied(spark):
    v = clustered(1, 4000, 40, 24, 0.03)
    rows = held(spark, v).select(F.col("photo_id").alias("id"), F.col("embedding").alias("v"))
    chosen = pivots.chosen_pivots(rows, "v", "id")
    tiles = pivots.tiled(rows, chosen, by=[], key="id", vector="v", size=50)
    ranges = pivots.bounds(tiles, chosen, by=[], vector="v")
    n = ranges.count()
    sizes = [r["count"] for r in tiles.groupBy("tile").count().collect()]
    assert max(sizes) <= 50 and sum(sizes) == 4000 and n == len(sizes)
    pairs = pivots.tile_pairs(ranges, float(np.arccos(0.92)), by=[])
    kept = pairs.count()
    assert kept < 0.1 * n * (n + 1) / 2  # over nine in ten are skipped
    copies = tiles.join(pairs.select("a", "b"), (F.col("tile") == F.col("a")) | (F.col("tile") == F.col("b"))).count() / 4000
    assert copies < 0.15 * n
    got = {(r["a"], r["b"]) for r in pivots.near_rows(rows, 0.92, size=50).collect()}
    assert got == brute(v, 0.92)


def test_one_hot_cluster_is_cut_in_tiles(spark):
    v = np.concatenate([np.tile([1.0, 0, 0, 0], (300, 1)), clustered(2, 600, 5, 4, 0.3)])
    rows = held(spark, v).select(F.col("photo_id").alias("id"), F.col("embedding").alias("v"))
    tiles = pivots.tiled(rows, pivots.chosen_pivots(rows, "v", "id"), by=[], key="id", vector="v", size=32)
    assert tiles.groupBy("tile").count().agg(F.max("count")).first()[0] <= 32
    assert {(r["a"], r["b"]) for r in pivots.near_rows(rows, 0.95, size=32).collect()} == brute(v, 0.95)


def test_edges(spark):
    """Null, zero, infinite and repeated vectors, null libraries, libraries beyond the cap, no rows, one row."""
    nan = float("nan")
    rows = [("a", 1, [1.0, 0.0]), ("a", 2, [2.0, 0.0]), ("a", 3, [0.0, 0.0]), ("a", 4, None), ("a", 5, [nan, 1.0]), ("a", 6, [float("inf"), 1.0]), ("a", 7, [1.0, None]), (None, 8, [1.0, 0.0]), (None, 9, [1.0, 0.0]), ("b", 10, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    pairs = lambda d, **more: {(r["a"], r["b"]) for r in dedup.near_pairs(d, by=["library"], **more).collect()}
    assert pairs(df) == pairs(df, most=None) == {(1, 2)}
    assert pairs(df, most=1) == set()
    assert pairs(df.where("false")) == pairs(df.where("photo_id = 1")) == pairs(df.where("photo_id in (3, 4)")) == set()
    with pytest.raises(Exception, match="different lengths"):
        dedup.near_pairs(spark.createDataFrame([("a", 1, [1.0], 1, ""), ("a", 2, [1.0, 0.0], 1, "")], SCHEMA)).collect()

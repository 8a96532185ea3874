"""Bursts by links of a window: the components of all pairs, without a row a pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiquarry.operators.graph import connected_components
from lumiquarry.operators.sweep import band_links
from lumiquarry.plans import catalog, moments

SCHEMA = "photo_id long, at double, lat double, lon double, v array<double>, faces array<array<double>>"


def photos(spark, n, span, seed):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = r.normal(size=4 if k % 13 else 3)
        faces = [r.normal(size=3 if r.random() < 0.8 else 2) for _ in range(int(r.integers(0, 4)))]
        faces = [(f / np.linalg.norm(f)).tolist() for f in faces]
        if k % 29 == 0:
            faces = [None, [1.0, None, 0.0], *faces]
        v = None if k % 31 == 0 else [*(v / np.linalg.norm(v)).tolist()[:-1], None] if k % 37 == 0 else (v / np.linalg.norm(v)).tolist()
        place = (34 + int(r.integers(0, 3)) * 0.00015, 77.0) if k % 3 else (None, 77.0)
        at = None if k % 41 == 0 else float(np.floor(r.uniform(0, span)) * 0.5)
        rows.append((k, at, *place, v, None if k % 43 == 0 else faces))
    return spark.createDataFrame(rows, SCHEMA)


def components(edges):
    return {tuple(x) for x in connected_components(edges, "a", "b").collect()}


@pytest.mark.parametrize("n,span,dense", [(600, 3000, 1 << 16), (600, 3000, 16), (1500, 20, 1 << 16)])
def test_links_join_what_all_pairs_join(spark, n, span, dense):
    p = photos(spark, n, span, n + span).repartition(5).localCheckpoint()
    edges = moments.burst_edges(p, similar=0.7 if span > 100 else 0.97)
    links = band_links(p, at="at", key="photo_id", width=moments.SECONDS, similar=0.7 if span > 100 else 0.97, degrees=moments.DEGREES, dense=dense)
    want = components(edges)
    assert len({c for _, c in want}) > 3 and components(links) == want


def test_copies_of_a_moment_give_no_row_a_pair(spark):
    """400 like photos of one second are 79,800 pairs and one forest."""
    p = spark.range(400).select(F.col("id").alias("photo_id"), F.lit(100.0).alias("at"), F.lit(34.0).alias("lat"), F.lit(77.0).alias("lon"), F.array(F.lit(3.0), F.lit(4.0)).alias("v"), F.array().cast("array<array<double>>").alias("faces"))
    links = moments.burst_links(p).collect()
    assert len(links) < 2 * 400 and {c for _, c in components(spark.createDataFrame(links))} == {0}


def test_the_query_makes_no_pairs(spark, monkeypatch):
    """The registered queries take the links: no row a pair of photos."""

    def pairs(*_, **__):
        raise AssertionError("pairs")

    monkeypatch.setattr(moments, "band_pairs", pairs)
    assert catalog.burst_moments(spark, "/root/testdata/sf0.001").count() >= 0

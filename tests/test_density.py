"""Density clusters: trees in arrays and in tiles against plain ones, blocks of any size, hot and equal rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiquarry.operators import cluster, density

from .test_pivots import clustered


def held(spark, v, block=lambda k: 0):
    return spark.createDataFrame([(block(k), k, x.tolist(), None) for k, x in enumerate(v)], "block int, photo_id long, v array<double>, tile int")


def weights(v, least):
    d = np.sqrt(np.maximum(2 - 2 * (v @ v.T), 0))
    core = np.sort(d, axis=1)[:, min(least, len(v) - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    left, out = set(range(1, len(v))), []
    best = reach[0].copy()
    while left:
        k = min(left, key=lambda x: best[x])
        out.append(best[k])
        left.discard(k)
        best = np.minimum(best, reach[k])
    return np.sort(out)


def test_forest_in_arrays():
    r = np.random.default_rng(1)
    for _ in range(20):
        n, m = 30, r.integers(0, 120)
        u, v, w = r.integers(0, n, m), r.integers(0, n, m), r.integers(0, 9, m).astype(float)
        taken, tree = density.spanning_forest(u, v, w, n)
        up = list(range(n))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        total = 0.0
        for k in np.argsort(w, kind="stable"):
            a, b = find(u[k]), find(v[k])
            if a != b:
                up[max(a, b)] = min(a, b)
                total += w[k]
        assert w[taken].sum() == total and [find(k) for k in range(n)] == tree.tolist()


@pytest.mark.parametrize("n,clusters,spread,size", [(300, 6, 0.1, 40), (260, 2, 0.02, 32), (200, 200, 0.3, 64)])
def test_trees_in_tiles_have_the_least_lengths(spark, n, clusters, spread, size):
    """Also where near rows are of one cluster, so that rounds must join far ones."""
    v = clustered(n, n, clusters, 10, spread)
    block = lambda k: k % 2
    edges = density.spanning_trees(held(spark, v, block), "block", key="photo_id", vector="v", least=4, size=size, neighbours=4).toPandas()
    for b in (0, 1):
        got = np.sort(edges.loc[edges["block"] == b, "w"].to_numpy())
        assert np.allclose(got, weights(v[b::2], 4), atol=1e-9)


@pytest.mark.parametrize("least", [3, 5, 20])
def test_large_blocks_are_clustered_like_small_ones(spark, least):
    v = np.concatenate([clustered(least, 250, 5, 8, 0.15), np.tile(np.eye(8)[0], (60, 1))])
    df = held(spark, v)
    rows = lambda **more: {(r["photo_id"], r["cluster"]) for r in density.density_clusters(df, "block", least=least, **more).collect()}
    one = rows()
    assert one == rows(dense=0, size=48, neighbours=3) and len(one) == len(v)
    assert {c for _, c in one} <= {k for k, c in one if k == c}


def test_edges(spark):
    """Small blocks are one cluster; null blocks and vectors are out; no rows give none; without ``by`` all rows are one block."""
    v = np.eye(3)
    df = held(spark, v).unionByName(spark.createDataFrame([(1, 10, [1.0, 0.0, 0.0], 1), (None, 11, [1.0, 0.0, 0.0], 1), (1, 12, None, 1)], "block int, photo_id long, v array<double>, tile int"))
    got = {tuple(r) for r in density.density_clusters(df, "block").collect()}
    assert got == {(0, 0, 0), (0, 1, 0), (0, 2, 0), (1, 10, 10)}
    assert density.density_clusters(df.where("false"), "block").count() == 0
    assert {tuple(r) for r in density.density_clusters(df).collect()} == {(0, 0), (1, 0), (2, 0), (10, 0), (11, 0)}


def greedy(v, distance):
    """Complete linkage by the nearest pair of clusters, again and again."""
    groups = [[k] for k in range(len(v))]
    d = 1 - v @ v.T
    while len(groups) > 1:
        far, a, b = min((d[np.ix_(x, y)].max(), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if far > distance:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("seed,distance,held_numbers", [(1, 0.3, 1 << 25), (2, 0.6, 1 << 25), (3, 0.9, 100), (4, 1.9, 1)])
def test_chain_linkage_is_greedy_linkage(seed, distance, held_numbers):
    v = clustered(seed, 60, 5, 6, 0.4)
    label = cluster.complete_linkage(v, distance, held=held_numbers)
    assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label)} == greedy(v, distance)
    assert all(label[k] <= k for k in range(60))


def test_persons_are_linkage_twice(spark):
    v = clustered(9, 120, 8, 16, 0.5)
    first = greedy(v, 0.5)
    groups = sorted(first, key=min)
    centre = np.stack([v[sorted(g)].mean(axis=0) for g in groups])
    centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    want = {}
    for joined in greedy(centre, 0.6):
        members = sorted(k for g in joined for k in groups[g])
        if len({k // 2 for k in members}) >= 2:
            want |= dict.fromkeys(members, members[0])
    df = held(spark, v).select(F.col("photo_id").alias("face_id"), F.floor(F.col("photo_id") / 2).alias("photo_id"), F.col("v").alias("embedding"))
    got = {r["face_id"]: r["person"] for r in cluster.persons(df, distance=0.5, merge=0.6).collect()}
    assert got == want


@pytest.mark.parametrize("by", [None, "block"])
def test_a_row_is_sent_once_a_block_of_tiles(spark, by, monkeypatch):
    """Vectors without structure: every tile needs all others, and a row goes to some PARTS tasks, not to one for each tile."""
    r = np.random.default_rng(5)
    v = r.normal(size=(1200, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    monkeypatch.setattr(density, "PARTS", 4)
    sent = []
    real = density.written
    monkeypatch.setattr(density, "written", lambda df, what: sent.append((what, out := real(df, what))) or out)
    rows = spark.createDataFrame([(k, k % 2, x.tolist()) for k, x in enumerate(v)], "photo_id long, block long, v array<double>")
    got = {x["photo_id"]: x["cluster"] for x in density.density_clusters(rows, by, dense=50, size=32).collect()}
    assert len(got) == 1200
    heads = next(df for what, df in sent if what == "heads").select("block", "b").distinct()
    tiles = heads.select("b").distinct().count()
    assert tiles > 30 and heads.count() / tiles <= 6
    whole = density.density_clusters(rows, by, dense=2000).collect()
    assert got == {x["photo_id"]: x["cluster"] for x in whole}

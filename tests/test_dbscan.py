"""Density clusters of points: against the plain algorithm, with crowded cells and cells that just touch."""

import math
import random

import pytest

from lumiquarry.operators import cluster

SCHEMA = "day string, photo_id long, lat double, lon double, node long, n int"


def plain(points, eps, least):
    near = {k: [j for j, (u, v) in points.items() if math.sqrt((x - u) ** 2 + (y - v) ** 2) <= eps] for k, (x, y) in points.items()}
    cores = {k for k in points if len(near[k]) >= least}
    name = {}
    for k in sorted(cores):
        todo = [k] if k not in name else []
        while todo:
            c = todo.pop()
            if c not in name:
                name[c] = k
                todo += [j for j in near[c] if j in cores]
    border = {k: min(name[j] for j in near[k] if j in cores) for k in points if k not in cores and any(j in cores for j in near[k])}
    return name | border


def held(spark, days):
    return spark.createDataFrame([(d, k, x, y, None, None) for d, points in days.items() for k, (x, y) in points.items()], SCHEMA)


@pytest.mark.parametrize("eps,least", [(0.1, 3), (0.03, 2), (0.25, 6), (0.05, 1)])
def test_against_the_plain_algorithm(spark, eps, least):
    r = random.Random(least)
    days: dict = {}
    for d, key in (("a", 0), ("b", 1000)):
        points = [(r.uniform(-1, 1), r.uniform(-1, 1)) for _ in range(150)]
        points += [(0.5 + r.gauss(0, 0.03), -0.5 + r.gauss(0, 0.03)) for _ in range(100)]  # a crowd
        points += [points[3]] * 12  # one place many times
        points += [(-0.9 + k * eps, 0.95) for k in range(8)]  # a chain at just that distance
        r.shuffle(points)
        days[d] = {key + k: p for k, p in enumerate(points)}
    got = {r["photo_id"]: r["cluster"] for r in cluster.dbscan(held(spark, days), by=["day"], eps=eps, least=least).collect()}
    assert got == plain(days["a"], eps, least) | plain(days["b"], eps, least)


@pytest.mark.parametrize("gap,together", [(0.9995, True), (1.0005, False)])
def test_crowds_that_just_touch_or_do_not(spark, gap, together):
    """Two discs of thousands of points each; only the very nearest points decide."""
    r = random.Random(5)
    eps, points = 1.0, {}
    for k in range(3000):
        a, rho = r.uniform(0, 2 * math.pi), 0.3 * math.sqrt(r.random()) * 0.999
        points[k] = (rho * math.cos(a) + (0 if k % 2 else 0.6 + gap), rho * math.sin(a))
    points[0], points[1] = (0.3 + gap, 0.0), (0.3, 0.0)
    got = {r["cluster"] for r in cluster.dbscan(held(spark, {"a": points}), eps=eps, least=3).collect()}
    assert got == ({0} if together else {0, 1})


def test_a_crowded_cell_makes_no_pairs(spark):
    rows = spark.range(100_000).selectExpr("'d' AS day", "id AS photo_id", "34 + (id % 1000) * 1e-7 AS lat", "77 + (id div 1000) * 1e-6 AS lon")
    assert cluster.dbscan(rows, by=["day"], eps=0.0025).groupBy("cluster").count().collect()[0]["count"] == 100_000


def test_edges(spark):
    rows = [("a", 1, 0.0, 0.0), ("a", 2, 0.0, 0.0), ("a", 3, 0.0, 0.0), ("a", 4, None, 0.0), ("a", 5, 0.0, None), ("a", 6, float("nan"), 0.0), ("a", 7, float("inf"), 0.0), (None, 8, 0.0, 0.0), ("b", 9, 0.0, 0.0)]
    df = spark.createDataFrame([(*x, None, None) for x in rows], SCHEMA)
    assert {tuple(x) for x in cluster.dbscan(df, by=["day"], eps=0.1).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert cluster.dbscan(df.where("false"), by=["day"]).count() == 0

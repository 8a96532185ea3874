"""Scans in groups of which one holds most rows: the same as plain windows, in segments of a task's share."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumiquarry.operators import islands, rank, scan


@pytest.fixture(scope="module")
def events(spark):
    """Two thirds of the rows are of user 1, a tenth of null; times repeat and lack."""
    r = random.Random(3)
    rows = []
    for k in range(6000):
        user = r.choices([1, None, *range(2, 30)], [4000, 600, *[50] * 28])[0]
        at = None if r.random() < 0.02 else float(r.randrange(40_000))
        v = np.array([r.random() - 0.3, r.random()])
        rows.append((user, at, k, (v / np.linalg.norm(v)).tolist(), None if r.random() < 0.3 else 34 + r.random() / 50, 77.0, r.choice([True, True, False, None]), float(r.randrange(300)) if r.random() < 0.95 else None))
    return spark.createDataFrame(rows, "user int, at double, id long, v array<double>, lat double, lon double, good boolean, value double").repartition(7)


@pytest.fixture
def cold(monkeypatch):
    """What the plain windows give."""
    def run(f):
        monkeypatch.setattr(scan, "hot_cuts", lambda *a: None)
        out = f()
        monkeypatch.undo()
        return out

    return run


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_segments_are_a_share(spark, events):
    cut = scan.segmented(events, ["user"], "at", True).where(F.col("_part").isNotNull())
    sizes = [r["count"] for r in cut.groupBy("user", "_part").count().where("_part < 256").collect()]
    assert len(sizes) == 4 and max(sizes) <= 3 * np.median(sizes) and {r["user"] for r in cut.select("user").distinct().collect()} == {1}
    assert scan.segmented(events.where("false"), ["user"], "at", True) is None


@pytest.mark.parametrize("kind", ["scenes", "sessions", "runs"])
def test_islands_of_a_hot_user(events, cold, kind):
    f = {
        "scenes": lambda: islands.scenes(events, ["user"], "at", "v", "id", gap=5, similar=0.8).select("id", "scene"),
        "sessions": lambda: islands.sessions(events, ["user"], "at", "lat", "lon", "id", gap=12, metres=2500).select("id", "block"),
        "runs": lambda: islands.good_runs(events.where("at is not null").dropDuplicates(["user", "at"]).select("user", "at", "good"), ["user"], "at", "good"),
    }[kind]
    if kind == "runs":  # of the same rows both times
        once = events.where("at is not null").groupBy("user", "at").agg(F.max("good").alias("good"))
        f = lambda: islands.good_runs(once, ["user"], "at", "good")
    got = rows(f())
    assert got == rows(cold(f)) and len(got) > 200


def test_averages_of_a_hot_group(events):
    w, ties = Window.partitionBy("user"), Window.partitionBy("user", "value")
    n = F.count("*").over(w)
    want = events.select("id", F.when(n > 1, (F.rank().over(w.orderBy("value")) - 1 + (F.count("*").over(ties) - 1) / 2) / (n - 1)).otherwise(1.0).alias("p"))
    assert rows(rank.average_percents(events, "value", ["user"], "p").select("id", "p")) == rows(want)
    assert rank.average_percents(events.where("false"), "value", ["user"], "p").count() == 0


def test_elements_of_hot_groups(spark, events):
    rest = spark.createDataFrame([(77, None)], "user int, value double")
    df = events.select("user", "value").union(rest)
    places = {"linear": rank.linear_place(95), "nearest": rank.nearest_place(95), "middle": rank.upper_median_place, "least": rank.linear_place(0), "most": rank.linear_place(100)}
    got = rank.group_elements(df, ["user"], "value", places)
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
    groups: dict = {}
    for r in df.collect():
        groups.setdefault(r["user"], []).extend([] if r["value"] is None else [r["value"]])
    assert len(groups) == got.count()
    for r in got.collect():
        v = sorted(groups[r["user"]])
        want = [np.percentile(v, 95), v[int(0.95 * (len(v) - 1))], v[len(v) // 2], v[0], v[-1]] if v else [None] * 5
        assert list(r)[1:] == (pytest.approx(want) if v else want)


def test_a_running_total_shuffles_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(rank, "written", lambda df, what: plans.append(df._jdf.queryExecution().executedPlan().toString()) or scan.written(df, what))
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 3).alias("x"))
    got = rank.running_total(df, [F.col("k")], F.col("x"), "t").orderBy("k").collect()
    assert [r["t"] for r in got] == np.cumsum([r["x"] for r in got]).tolist()
    assert plans[0].count("Exchange") == 1 and "rangepartitioning" in plans[0] and "Window" not in plans[0]
    assert rank.running_total(df.where("false"), [F.col("k")], F.col("x"), "t").count() == 0

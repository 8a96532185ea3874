"""What only shows on larger tables: neighbouring doubles at a percentile, copies of rows, work in one task."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiquarry.operators import cluster, pivots, rank
from lumiquarry.plans import curate


@pytest.mark.parametrize("values,percent", [([14.02, 14.02, 14.02, 14.020000000000001], 75), ([25.198] * 7 + [25.198000000000004], 95), ([3.176] * 4 + [4.095088619633823] * 2, 75)])
def test_percentiles_between_neighbouring_doubles_are_those_of_sql(spark, values, percent):
    want = duckdb.execute("SELECT quantile_cont(v, $2) FROM (SELECT unnest($1::DOUBLE[]) AS v)", [values, percent / 100]).fetchone()[0]
    p = spark.createDataFrame([("d", k, v, 0.0) for k, v in enumerate(values)], "day string, photo_id long, ap25 double, nima double")
    assert rank.whole_percentile(p, p["ap25"], percent).first()[0] == want
    assert rank.group_elements(p, ["day"], "ap25", {"x": rank.linear_place(percent)}).first()["x"] == want
    kept = curate.curate(p, p, by=["day"], percent=percent, ap_weight=1.0, nima_weight=0.0)
    assert kept.count() == sum(v >= want for v in values)


@pytest.mark.parametrize("size", [64, 1024])
def test_a_row_is_copied_once_a_block_however_small_tiles_are(spark, size, monkeypatch):
    """Vectors without structure: all tiles meet, and a row goes to some BLOCKS tasks, not to one for each tile."""
    r = np.random.default_rng(3)
    v = r.normal(size=(1500, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    monkeypatch.setattr(pivots, "BLOCKS", 5)
    sent = []
    real = pivots.written
    monkeypatch.setattr(pivots, "written", lambda df, what: sent.append((what, out := real(df, what))) or out)
    got = {(x["a"], x["b"]) for x in pivots.near_rows(rows, 0.4, size=size, small=0).collect()}
    near = v @ v.T >= 0.4
    assert got == {(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b}
    tiles, dealt = (next(df for what, df in sent if what == name) for name in ("tiles", "tilepairs"))
    copies = dealt.join(tiles.groupBy("tile").count(), "tile").agg(F.sum("count")).first()[0] / 1500
    assert copies <= 6


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_linkage_of_one_component_is_no_task_of_its_own(spark, local, monkeypatch):
    """All rows hang together; clusters are those of the chain of nearest neighbours, which no longer runs."""
    r = np.random.default_rng(5)
    v = r.normal(size=(160, 6))
    v = np.concatenate([v, v[:20]]) / np.linalg.norm(np.concatenate([v, v[:20]]), axis=1, keepdims=True)
    want = cluster.complete_linkage(v, 0.6)
    monkeypatch.setattr(cluster, "LOCAL", local)
    monkeypatch.delattr(cluster, "complete_linkage")
    got = cluster.linked(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>"), 0.6)
    assert {x["id"]: x["cluster"] for x in got.collect()} == dict(enumerate(want.tolist()))

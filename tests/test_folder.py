"""A media folder as a data source and as a stream of polls, up to what watching makes of it."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lumiquarry.sources import folder, media
from lumiquarry.streaming import watch


@pytest.fixture(scope="module")
def known(spark):
    folder.registered(spark)
    return spark


def filled(root, n=60):
    deep = root / "a" / "b" / "c"
    deep.mkdir(parents=True)
    for k in range(n):
        (deep / f"{k}.jpg").write_bytes(b"x" * k)
    for name in ("_DSC1.NEF", ".hidden.PNG", "e.txt", "a/v.MP4"):
        (root / name).write_bytes(b"yy")
    for name in ("node_modules", ".git", ".lumiquarry"):
        (root / name).mkdir()
        (root / name / "no.jpg").write_bytes(b"n")
    (root / "dangling.jpg").symlink_to(root / "nothing.jpg")


def test_one_deep_folder_is_read_by_several_tasks(known, tmp_path):
    filled(tmp_path)
    df = known.read.format("media_folder").option("parts", 4).option("each", 10).load(str(tmp_path))
    rows = df.withColumn("task", F.spark_partition_id()).collect()
    want = {r["path"]: (r["kind"], r["size_bytes"], r["mtime"]) for r in media.listed(known, str(tmp_path)).collect()}
    assert {r["path"]: (r["kind"], r["size_bytes"], r["mtime"]) for r in rows} == want and len(rows) == len(want) == 63
    tasks: dict = {}
    for r in rows:
        if "/c/" in r["path"]:
            tasks[r["task"]] = tasks.get(r["task"], 0) + 1
    assert len(tasks) >= 4 and max(tasks.values()) < 25


def test_many_folders_are_dealt_whole(known, tmp_path):
    for k in range(50):
        (tmp_path / f"d{k}" / "x").mkdir(parents=True)
        (tmp_path / f"d{k}" / "x" / "p.jpg").write_bytes(b"1")
    made = folder.shares(str(tmp_path), 2, 10, ())
    assert len(made) == 50 and all(s.deep for s in made)
    assert known.read.format("media_folder").option("parts", 2).load(str(tmp_path)).count() == 50


def test_nothing_there(known, tmp_path):
    for path in (tmp_path, tmp_path / "gone"):
        assert known.read.format("media_folder").load(str(path)).count() == 0


def test_polls_reach_the_debounce(known, tmp_path):
    """A file that is still being written comes out once it is the same in two polls."""
    root, target = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    (root / "done.jpg").write_bytes(b"whole")
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    known.conf.set(key, "false")
    polls = known.readStream.format("media_folder").schema(folder.POLLS).option("every", 0).load(str(root))
    q = watch.debounced(polls).writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="3 seconds").start()
    try:
        grown = 0
        until = time.time() + 60
        seen: set = set()
        while time.time() < until and "slow.jpg" not in seen:
            if grown < 3:
                grown += 1
                (root / "slow.jpg").write_bytes(b"x" * grown)
            time.sleep(3)
            assert q.exception() is None
            if os.path.isdir(target) and any(n.endswith(".parquet") for n in os.listdir(target)):
                seen = {os.path.basename(r["path"]) for r in known.read.schema("poll long, path string").parquet(target).collect()}
        rows = known.read.parquet(target).collect()
    finally:
        q.stop()
        known.conf.unset(key)
    first = {n: min(r["poll"] for r in rows if r["path"].endswith(n)) for n in ("done.jpg", "slow.jpg")}
    assert 1 <= first["done.jpg"] < first["slow.jpg"]

"""Files, side files, exports and streams on temporary folders."""

import json
import os
import queue

import pytest
from pyspark.sql import functions as F

from lumiquarry.operators import mutate
from lumiquarry.plans import export
from lumiquarry.sources import media, side_files
from lumiquarry.streaming import watch


def test_listing(spark, tmp_path):
    for name in ("a.JPG", "_DSC1.NEF", ".hidden.png", "sub/b.mp4", "node_modules/c.jpg", ".state/d.jpg", "e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {os.path.basename(r["path"]): r["kind"] for r in media.listed(spark, str(tmp_path), state_folder=".state").collect()}
    assert got == {"a.JPG": "jpeg", "_DSC1.NEF": "raw", ".hidden.png": "jpeg", "b.mp4": "video"}
    paths = [str(tmp_path / "a.JPG"), str(tmp_path / "gone.jpg")]
    assert media.of_paths(spark, paths).count() == 1
    one = {os.path.basename(r["path"]): r["sha256"] for r in media.hashed(media.of_paths(spark, paths), piece=1).collect()}
    assert one == {"a.JPG": "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"}
    assert media.hashed(spark.createDataFrame([("/gone.jpg",)], "path string")).first()["sha256"] is None
    assert media.listed(spark, str(tmp_path / "nowhere")).count() == 0


def test_sampling_and_previews(spark):
    frames = lambda n: spark.range(1).select(media.frame_indices(F.lit(n), F.lit(15.0))).first()[0]
    assert len(frames(60)) == 12 and frames(60)[0] == 0 and frames(60)[-1] == 59 and frames(5) == [0, 1, 2, 3, 4] and frames(1) == [0] and frames(0) is None
    size = spark.range(1).select(media.preview_size(F.lit(4001), F.lit(3000), 1024), media.preview_size(F.lit(100), F.lit(50), 256)).first()
    assert tuple(size[0]) == (1024, 767) and tuple(size[1]) == (100, 50)


def test_inference_plug_in(spark):
    files = spark.createDataFrame([(str(k), bytes([k])) for k in range(40)], "path string, content binary")
    out = media.inferred(files, lambda batch: [None if b == b"\x05" else (float(b[0]), len(batch) <= 16) for b in batch], "value double, small boolean")
    rows = {r["path"]: r for r in out.collect()}
    assert rows["7"]["value"] == 7 and rows["5"]["value"] is None and all(r["small"] in (True, None) for r in rows.values())
    logits = spark.createDataFrame([(1, [5.0, -5.0, 5.0, 5.0])], "photo_id long, logits array<double>")
    classes = spark.createDataFrame([(0, " Sea", 0.5), (1, "sky", 0.5), (2, "drop", 0.5), (3, "SEA ", 0.5)], "class int, tag string, threshold double")
    assert media.top_tags(logits, classes, ["drop"]).first()["tags"] == ["sea"]


def test_side_files(spark, tmp_path):
    default = {"a": ["b"]}
    for text in (None, "", "{", "{}", "[1]", '{"x": 1}', '{"x": [1]}'):
        assert side_files.keyword_map(text, default) == default
    assert side_files.keyword_map('{"x": ["y"]}', default) == {"x": ["y"]}
    (tmp_path / "l.json").write_text(json.dumps([{"name": "A", "lat": 1, "lon": 2}, {"name": "B"}]))
    assert [r["name"] for r in side_files.landmarks(spark, str(tmp_path / "l.json")).collect()] == ["A"]
    assert side_files.landmarks(spark, str(tmp_path / "none.json")).count() == 0
    spark.range(3).selectExpr("id as photo_id").write.parquet(str(tmp_path / "one"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_bytes(b"no parquet at all")
    half = tmp_path / "half"
    spark.range(5000).selectExpr("id as photo_id").coalesce(1).write.parquet(str(half))
    (part,) = half.glob("*.parquet")
    whole = part.read_bytes()
    part.write_bytes(whole[:4] + b"\0" * (len(whole) // 2) + whole[4 + len(whole) // 2 :])  # the footer is whole, the pages are not
    (half / f".{part.name}.crc").unlink(missing_ok=True)
    spark.range(2).selectExpr("id as other").write.parquet(str(tmp_path / "other"))
    libs = [{"id": n, "path": str(tmp_path / n)} for n in ("one", "gone", "broken", "half", "other")]
    assert side_files.libraries(spark, libs, lambda s, p: s.read.parquet(p), "photo_id long").count() == 3


def test_slices(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", None), (2, "y", "ram")], "id int, tag string, source string")
    mutate.slices_written(rows, str(tmp_path / "t"), "source")
    mutate.slices_written(rows.where("source = 'ram'").withColumn("tag", F.lit("z")), str(tmp_path / "t"), "source")
    assert {(r["id"], r["tag"], r["source"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "x", "legacy"), (2, "z", "ram")}


def test_exports(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"abc")
    items = spark.createDataFrame([(1, str(tmp_path / "a.jpg"), "2024-01-02", 7), (2, "/gone.jpg", None, None)], "photo_id long, path string, day string, rank int")
    plan = export.export_plan(items, by_day=True).orderBy("photo_id").collect()
    assert [r["target"] for r in plan] == ["2024-01-02/007_a.jpg", "gone.jpg"]
    done = export.copied(plan, str(tmp_path / "out"))
    assert (done["count"], done["bytes"], len(done["skipped"])) == (1, 3, 1) and (tmp_path / "out/2024-01-02/007_a.jpg").exists()
    assert export.copied(plan, str(tmp_path / "zip"), "all.zip")["count"] == 1
    page = export.recap_html("T <b>", "May 1", {"km": 3}, [{"title": "d", "images": ["data:x"]}, {"title": "none", "images": []}])
    assert "T &lt;b&gt;" in page and "http" not in page and page.count("<section>") == 1
    export.state_written(str(tmp_path / "s.json"), {"on": True})
    assert json.loads((tmp_path / "s.json").read_text()) == {"on": True} and not list(tmp_path.glob("*.tmp"))


def test_watch_candidates(spark):
    files = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "path string, mtime double")
    known = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "path string, mtime double")
    assert {r["path"] for r in watch.candidates(files, known).collect()} == {"b", "c"}


@pytest.fixture
def only_data(spark):
    """State that expires by the clock has a batch to run at any time: these streams run one where there is data, and so come to an end."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def test_debounce(spark, tmp_path, only_data):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "poll long, path string, size long, mtime double"
    polls = [[("a", 1, 1.0), ("b", 1, 1.0)], [("a", 1, 1.0), ("b", 2, 1.0)], [("b", 2, 1.0)], [("a", 1, 1.0)], [("a", 1, 1.0)]]
    os.makedirs(source)
    stream = watch.debounced(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for k, rows in enumerate(polls):
            spark.createDataFrame([(k, *r) for r in rows], schema).coalesce(1).write.mode("append").parquet(source)
            stream.processAllAvailable()
    finally:
        stream.stop()
    got = {(r["poll"], r["path"]) for r in spark.read.parquet(target).collect()}
    assert got == {(1, "a"), (2, "b"), (4, "a")}


def test_the_state_of_vanished_paths_goes(spark, tmp_path, only_data):
    """Forty paths are polled once, one stays: after their time to live the state has one row."""
    import time

    source, schema = str(tmp_path / "in"), "poll long, path string, size long, mtime double"
    os.makedirs(source)
    q = watch.debounced(spark.readStream.schema(schema).parquet(source), ttl_ms=3000).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).start()
    sizes = []
    try:
        for k in range(6):
            rows = [(k, "stays", 1, 1.0)] + [(k, f"gone{n}", 1, 1.0) for n in range(40 if k == 0 else 0)]
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            q.processAllAvailable()
            sizes.append(next(p["stateOperators"][0]["numRowsTotal"] for p in reversed([json.loads(x.json) for x in q.recentProgress]) if p["numInputRows"]))
            if k == 1:
                time.sleep(4)
    finally:
        q.stop()
    assert sizes[0] >= 41 > 10 > sizes[-1]


def test_debounce_needs_its_store(spark):
    was = spark.conf.get(watch.STORE_KEY)
    spark.conf.set(watch.STORE_KEY, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="stateStore"):
            watch.debounced(spark.createDataFrame([], "poll long, path string, size long, mtime double"))
    finally:
        spark.conf.set(watch.STORE_KEY, was)


def test_stages_and_progress():
    ran = []
    stages = {s: (lambda s=s: ran.append(s)) for s in watch.STAGES}
    assert watch.run_stages(stages, lambda s: s != "video") == ["index", "classical", "embed", "tag", "story"] == ran
    assert watch.run_stages(stages, lambda s: True, lambda: True) == []
    bus = watch.Progress(2)
    q = bus.subscribe()
    for k in range(5):
        bus.publish({"k": k})
    assert [q.get_nowait()["k"] for _ in range(2)] == [0, 1]
    with pytest.raises(queue.Empty):
        q.get_nowait()


def test_stream_batches(spark, tmp_path):
    spark.range(4).selectExpr("cast(id as string) as path").write.parquet(str(tmp_path / "in"))
    seen, later = [], []
    q = watch.each_batch(spark.readStream.schema("path string").parquet(str(tmp_path / "in")), lambda b: seen.append(b.count()) or b.count(), [lambda: later.append(1)], str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(seen) == 4 and later

"""Names and summaries of places, faces as rows, recaps, rebuilt tables."""

import json

from pyspark.sql import functions as F

from lumiquarry.operators import mutate
from lumiquarry.plans import export, places
from lumiquarry.sources import media

POINTS = "photo_id long, lat double, lon double, name string, payload string"
CACHE = "lat_round double, lon_round double, payload string, display_name string"
MARKS = "name string, lat double, lon double, radius_m double"


def test_names_come_from_cache_landmarks_and_look_up(spark):
    rows = [(1, 10.0001, 20.0), (2, 10.0, 20.0004), (3, 11.0, 20.0), (4, 60.0, 20.02), (5, 60.0002, 20.0201), (6, 61.0, 20.0), (7, 62.0, 20.0), (8, None, 20.0), (9, 12.0, 20.0)]
    points = spark.createDataFrame([(*r, None, None) for r in rows], POINTS)
    cache = spark.createDataFrame([(10.0, 20.0, None, "Old"), (11.0, 20.0, None, None)], CACHE)
    marks = spark.createDataFrame([("Far", 60.0, 20.05, 9000.0), ("Tower", 60.0, 20.0, None), ("Small", 60.0, 20.019, 10.0), ("Zero", 12.0, 20.01, 0.0)], MARKS)
    asked = []

    def look_up(cells):
        asked.extend((r["lat_round"], r["lon_round"]) for r in cells.collect())
        return spark.createDataFrame([(61.0, 20.0, json.dumps({"name": "Hill"})), (62.0, 20.0, None)], "lat_round double, lon_round double, payload string")

    names, gained = places.resolved(points, cache, marks, look_up)
    got = {r["photo_id"]: (r["display_name"], r["source"]) for r in names.collect()}
    assert got == {1: ("Old", "cache"), 2: ("Old", "cache"), 3: ("Unknown location", "cache"), 4: ("Tower", "landmark"), 5: ("Tower", "landmark"), 6: ("Hill", "look-up"), 7: ("Unknown location", "look-up"), 9: ("Zero", "landmark")}
    assert sorted(asked) == [(61.0, 20.0), (62.0, 20.0)]
    more = {(r["lat_round"], r["lon_round"]): r["display_name"] for r in gained.collect()}
    assert more == {(60.0, 20.02): "Tower", (61.0, 20.0): "Hill", (62.0, 20.0): "Unknown location", (12.0, 20.0): "Zero"}
    again, nothing = places.resolved(points, cache.unionByName(gained), marks, look_up)
    assert {r["photo_id"]: r["display_name"] for r in again.collect()} == {k: v for k, (v, _) in got.items()} and nothing.count() == 0
    silent, kept = places.resolved(points, cache, marks)
    assert {r["photo_id"] for r in silent.where("display_name IS NULL").collect()} == {6, 7} and kept.count() == 2
    none, no = places.resolved(points.where("false"), cache, marks, look_up)
    assert none.count() == no.count() == 0


def test_summaries_are_relevant(spark):
    page = lambda extract, kind="standard": json.dumps({"type": kind, "extract": extract})
    long = "A long enough sentence. " * 30
    rows = [
        ("Leh", page(" Leh is a town in the north. "), [], "Leh is a town in the north."),
        ("Leh", page("many things are called so", "disambiguation"), [("Leh Palace", page("A palace above the old town."))], "A palace above the old town."),
        ("Assoo", None, [("Barbara Dolores", page("An actor born somewhere far.")), ("ASSOO lake", page("short")), ("Lake Assoo", page("A lake that is very salty."))], "A lake that is very salty."),
        ("Assoo", page("too short"), [("Other", page("An article of another thing."))], None),
        ("X", "no json", None, None),
        ("Y", page(long), [], "A long enough sentence. " * 19 + "A long enough sentence."),
    ]
    df = spark.createDataFrame([(k, t, d, f) for k, (t, d, f, _) in enumerate(rows)], "k int, title string, direct string, found array<struct<title:string,payload:string>>")
    got = {r["k"]: r["s"] for r in df.select("k", places.summary(F.col("title"), F.col("direct"), F.col("found")).alias("s")).collect()}
    assert got == {k: (want if want is None or len(want) <= 480 else got[k]) for k, (*_, want) in enumerate(rows)} and 400 < len(got[5]) <= 480


def test_faces_are_rows(spark):
    found = spark.createDataFrame([("a", [(1.0, [0.1]), (0.5, [0.2])]), ("b", []), ("c", None)], "path string, faces array<struct<score:double,embedding:array<double>>>")
    assert [tuple(r) for r in media.faces_of(found).orderBy("face_index").collect()] == [("a", 0, 1.0, [0.1]), ("a", 1, 0.5, [0.2])]


def test_recap_has_its_images_and_captions(spark):
    rows = [(f"2024-01-{1 + k % 3:02d}" if k % 10 else None, k, k, None, 5.0 if k % 2 else None, float(k) if k % 2 else None, None) for k in range(60)]
    items = spark.createDataFrame(rows, "day string, photo_id long, rank int, taken_at timestamp, nima double, ap25 double, iqa double")
    captions = spark.createDataFrame([("2024-01-01", "First", ["a"]), ("2024-01-01", "First", ["a"])], "day string, caption string, hashtags array<string>")
    got = export.recap_images(items, captions, 10).collect()
    days = {d: [r for r in got if r["day"] == d] for d in {r["day"] for r in got}}
    assert len(got) == 10 and None not in days and all(len(r) >= 3 for r in days.values()) and {r["photo_id"] for r in got} >= {59, 58 - 1, 55}
    assert {(r["day"], r["caption"], tuple(r["hashtags"])) for r in got} == {("2024-01-01", "First", ("a",)), ("2024-01-02", "", ()), ("2024-01-03", "", ())}
    assert all([r["place"] for r in sorted(own, key=lambda r: r["photo_id"])] == list(range(len(own))) for own in days.values())
    assert export.recap_images(items.where("false"), captions).count() == 0


def test_a_rebuilt_table_is_the_new_one(spark, tmp_path):
    for n in (5, 2):
        mutate.rebuilt(spark.range(n), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2

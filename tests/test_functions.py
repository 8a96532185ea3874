"""Column functions, pixels and small drivers against values worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiquarry.functions import faces, geo, pixels, scores, texts, vec


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    assert one(spark, vec.dot(a, b), vec.norm(a)) == (24.0, 5.0)
    assert one(spark, vec.unit(F.array(F.lit(0.0), F.lit(0.0))), vec.unit(a, floor=10.0)) == ([0.0, 0.0], [0.3, 0.4])
    assert one(spark, vec.cosine(a, b))[0] == pytest.approx(0.96)
    assert one(spark, vec.argmax(F.array(*[F.lit(x) for x in (1, 5, 5, 2)]), lambda x: x % 5))[0] == 2


def test_distances(spark):
    p = [F.lit(x) for x in (34.0, 77.0, 34.0, 78.0)]
    assert one(spark, geo.km_per_deg_lon(F.lit(34.0)))[0] == pytest.approx(92.29, abs=0.01)
    assert one(spark, geo.haversine_km(*p))[0] == pytest.approx(92.19, abs=0.05)
    assert one(spark, geo.degrees_apart(*p))[0] == 1.0
    assert one(spark, geo.svg_points(F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.26).alias("y")), F.struct(F.lit(3.0).alias("x"), F.lit(4.0).alias("y")))))[0] == "1.0,2.3 3.0,4.0"


def test_score_rules(spark):
    n = F.lit(None).cast("double")
    assert one(spark, scores.blend(F.lit(5.0), n), scores.mean_available(n, F.lit(4.0)), scores.mean_available(n, n)) == (None, 4.0, None)
    ramp = [one(spark, scores.taste_weight(F.lit(x)))[0] for x in (0, 100, 550, 1000, 50_000)]
    assert ramp == pytest.approx([0, 0, 0.2, 0.4, 0.4])
    assert one(spark, scores.sigmoid(F.lit(-800.0)), scores.sigmoid(F.lit(800.0))) == (0.0, 1.0)
    assert one(spark, scores.dead_footage(F.lit(2), F.lit(10)), scores.dead_footage(F.lit(3), F.lit(10)), scores.dead_footage(F.lit(0), F.lit(0))) == (True, False, None)
    assert one(spark, scores.reject_reason(F.lit(10.0), n, n, F.lit(0)), scores.reject_reason(F.lit(50.0), F.lit(0.99), F.lit(0.0), F.lit(0)))[:2] == ("severe_blur", "all_black")


def test_texts(spark):
    assert one(spark, texts.breadcrumb(F.array(F.struct(F.lit("Pass").alias("name"), F.lit(5359).alias("elevation_m")), F.struct(F.lit("Lake").alias("name"), F.lit(None).cast("int").alias("elevation_m")))))[0] == "Pass (5,359m) › Lake"
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    title = lambda *n: one(spark, texts.route_title(F.lit("2024-01-02"), F.lit(9), names(*n)))[0]
    assert title("Leh") == "2024-01-02 · Exploring Leh · 9 photos"
    assert title("Leh", "Nubra", "Leh") == "2024-01-02 · Leh to Nubra · 9 photos"
    assert title("Leh", "Pass", "Nubra") == "2024-01-02 · Leh to Nubra via Pass · 9 photos"
    assert one(spark, texts.trim_summary(F.lit("One two. Three! Four?"), 16), texts.trim_summary(F.lit("x" * 30), 10)) == ("One two. Three!", "x" * 10)
    assert one(spark, texts.canonical(F.lit("  The, QUICK  fox! ")), texts.strip_counts(F.lit("Leh · 42 photos, 6 scenes")), texts.clean_name(F.lit("a/b:c"))) == ("the quick fox", "Leh", "a_b_c")
    assert one(spark, texts.dms_degrees(F.lit("34/1 30/1 0/1"), F.lit("S")), texts.dms_degrees(F.lit("34/0 1/1 1/1"), F.lit("N")), texts.dms_degrees(F.lit("x"), F.lit("N"))) == (-34.5, None, None)
    assert one(spark, texts.keyword_bucket(names("snow", "peak"), {"Seas": ["sea"], "Both": ["w p"]}))[0] == "Both"
    payload = '{"type": "administrative", "name": "Ladakh", "address": {"natural": " Tso ", "city": "Leh"}}'
    assert one(spark, texts.place_name(F.lit(payload)), texts.place_name(F.lit('{"name": "Fort X"}')), texts.place_name(F.lit("{}"))) == ("Tso", "Fort X", "Unknown location")


def test_faces(spark):
    rows = [(1, 0.1, 0.0, 0.1), (2, 0.1, 80.0, 0.1), *[(3, e, 0.0, 0.1) for e in (0.1, 0.9, 0.9)], *[(4, 0.1, 0.0, 0.1)] * 6, (5, 0.1, 0.0, 0.0001), (5, 0.9, 0.0, 0.1), (6, None, None, None)]
    df = spark.createDataFrame(rows, "photo_id int, eyes_open double, yaw double, face_area_ratio double")
    got = {r["photo_id"]: round(r["penalty"], 2) for r in faces.penalties(df).collect()}
    assert got == {1: 0.30, 2: 0.30, 3: 0.45, 4: 0.50, 5: 0.0, 6: 0.0}
    roll = {r["photo_id"]: (r["any_closed"], r["all_away"]) for r in faces.rollup(df).collect()}
    assert roll[2] == (True, True) and roll[6] == (False, False) and roll[3] == (True, False)


def test_pixels():
    flat, noise = np.full((32, 32, 3), 128, np.uint8), np.random.default_rng(0).integers(0, 256, (32, 32, 3)).astype(np.uint8)
    assert pixels.laplacian_variance(flat) == pytest.approx(0) and pixels.laplacian_variance(noise) > 1000
    assert pixels.exposure(np.zeros((8, 8, 3)))["score"] == 0 and pixels.exposure(flat)["score"] > 0.4
    assert pixels.is_low_light(np.zeros((4, 4, 3))) and not pixels.is_low_light(flat)
    assert sum(pixels.histograms(noise)["luma"]) == 32 * 32 and len(pixels.histograms(noise)["r"]) == 64
    assert pixels.straighten_angle([(0, 0, 100, 10), (0, 0, 10, -1), (0, 0, 1, 50)]) == pytest.approx(5.71, abs=0.01)
    assert pixels.straighten_angle([]) == 0 and pixels.auto_tone(flat).shape == flat.shape


def test_auto_tone():
    r = np.random.default_rng(1)
    dark = (r.random((40, 40, 1)) * np.array([0.30, 0.28, 0.26]) * 255).astype(np.uint8)
    out = pixels.auto_tone(dark)
    assert out.dtype == np.uint8 and out.shape == dark.shape
    assert out.mean() > dark.mean() + 30 and out.max() > 200  # brighter, wider
    gray_ = np.repeat(r.integers(0, 256, (30, 30, 1)), 3, axis=2).astype(np.uint8)
    toned = pixels.auto_tone(gray_).astype(int)
    assert (toned.max(axis=2) - toned.min(axis=2)).max() <= 1  # grey stays grey
    assert (pixels.auto_tone(np.zeros((4, 4, 3), np.uint8)) < 60).all()

"""What a face's landmarks say, and what a photo's faces cost it within its stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Landmarks of an eye, extents of closed and open eyes, penalties and their cap.
NEIGHBOURS, CLOSED_RATIO, OPEN_RATIO = 8, 0.12, 0.30
LEAST_AREA, CLOSED_EYES, FRONTAL_YAW, AWAY_YAW = 0.005, 0.35, 30.0, 45.0
ONE_CLOSED, GROUP_CLOSED, OTHER_CLOSED, CAP = 0.30, 0.45, 0.20, 0.5


def eye_extent(landmarks: Column, eye: Column) -> Column:
    """Height by width of the landmarks (structs x, y) nearest an eye's centre; 0 without width."""
    apart = lambda p: F.pow(p["x"] - eye["x"], F.lit(2)) + F.pow(p["y"] - eye["y"], F.lit(2))
    near = F.slice(F.array_sort(F.transform(landmarks, lambda p, i: F.struct(apart(p).alias("d"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y")))), 1, NEIGHBOURS)
    span = lambda c: F.array_max(F.transform(near, lambda p: p[c])) - F.array_min(F.transform(near, lambda p: p[c]))
    return F.when(span("x") > 1e-9, span("y") / span("x")).otherwise(0.0)


def eyes_open(landmarks: Column, left: Column, right: Column) -> Column:
    mean = (eye_extent(landmarks, left) + eye_extent(landmarks, right)) / 2
    return F.when(mean.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (mean - CLOSED_RATIO) / (OPEN_RATIO - CLOSED_RATIO))))


def _clip(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x)))


def yaw(left: Column, right: Column, nose: Column) -> Column:
    apart = F.sqrt(F.pow(right["x"] - left["x"], F.lit(2)) + F.pow(right["y"] - left["y"], F.lit(2)))
    return F.when(apart > 1e-9, _clip((nose["x"] - (left["x"] + right["x"]) / 2) / apart) * 90).otherwise(0.0)


def pitch(left: Column, right: Column, nose: Column, mouth_left: Column, mouth_right: Column) -> Column:
    eyes, mouth = (left["y"] + right["y"]) / 2, (mouth_left["y"] + mouth_right["y"]) / 2
    apart = F.sqrt(F.pow(right["x"] - left["x"], F.lit(2)) + F.pow(right["y"] - left["y"], F.lit(2)))
    return F.when((apart > 1e-9) & (F.abs(mouth - eyes) > 1e-9), _clip(0.55 - F.try_divide(nose["y"] - eyes, mouth - eyes)) * 90).otherwise(0.0)


def area_ratio(width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    share = F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0)) / (image_width * image_height).cast("double")
    return F.when((image_width > 0) & (image_height > 0), F.least(F.lit(1.0), share))


def rollup(faces: DataFrame, by: str = "photo_id") -> DataFrame:
    """(by, any_closed, all_away): faces without the attribute don't count, and without any both are false."""
    closed, away = F.col("eyes_open") < CLOSED_EYES, F.abs(F.col("yaw")) > AWAY_YAW
    return faces.groupBy(by).agg(F.coalesce(F.bool_or(closed), F.lit(False)).alias("any_closed"), F.coalesce(F.bool_and(away), F.lit(False)).alias("all_away"))


def penalties(faces: DataFrame, by: str = "photo_id") -> DataFrame:
    """(by, penalty). Background faces count only where there are no others; the sum is capped."""
    big = F.coalesce(F.col("face_area_ratio") >= LEAST_AREA, F.lit(True))
    closed = F.coalesce(F.col("eyes_open") < CLOSED_EYES, F.lit(False))
    frontal = F.coalesce(F.abs(F.col("yaw")) <= FRONTAL_YAW, F.lit(False))
    sums = faces.groupBy(by).agg(*[F.count_if(x).alias(n) for n, x in {"n_big": big, "closed_big": big & closed, "frontal_big": big & frontal, "n_all": F.lit(True), "closed_all": closed, "frontal_all": frontal}.items()])
    pick = lambda c: F.when(F.col("n_big") > 0, F.col(f"{c}_big")).otherwise(F.col(f"{c}_all"))
    n, shut, front = pick("n"), pick("closed"), pick("frontal")
    cost = F.when(shut == 0, 0.0).when(n == 1, ONE_CLOSED).when((n >= 3) & (front >= F.ceil(0.6 * n)), GROUP_CLOSED * shut).otherwise(OTHER_CLOSED * shut)
    return sums.select(by, F.least(F.lit(CAP), cost).alias("penalty"))

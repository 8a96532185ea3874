"""Outer, semi, anti, division, range and nearest joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiquarry.functions.geo import EARTH_M, degrees_apart, equirect_km, haversine_m


def star(photos: DataFrame, *sides: DataFrame, on: str = "photo_id") -> DataFrame:
    """One row of ``photos`` with the columns of each 1:1 side, null without."""
    for s in sides:
        photos = photos.join(s, on, "left")
    return photos


def hub_join(rows: DataFrame, values: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The inner join of ``rows`` with ``values`` (a row per key; ``count``: how many rows have it, ``total``: all rows).

    Adaptive execution does not split a skewed key where one side is an aggregate of the same stage. Here the keys that
    have more rows than a task's share of ``total`` are broadcast, fewer of them than there are shuffle partitions; the
    rows of all other keys are shuffled. Null keys match nothing.
    """
    limit = max(1, total // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    added = [c for c in values.columns if c not in (key, count)]
    held = F.struct(*added)
    hub = "_hub"
    while hub in rows.columns or hub in added:
        hub += "_"
    marked = rows.join(F.broadcast(values.where(F.col(count) > limit).select(key, held.alias(hub))), key, "left")
    large = marked.where(F.col(hub).isNotNull()).select(*rows.columns, *[F.col(hub)[c].alias(c) for c in added])
    rest = marked.where(F.col(hub).isNull()).select(*rows.columns).join(values.where(F.col(count) <= limit).drop(count), key)
    return large.union(rest.select(*rows.columns, *added))


def collapsed(photos: DataFrame, members: DataFrame, on: str = "photo_id") -> DataFrame:
    """Photos of no stack, and the primary of each stack. ``members`` has (on, moment_id, primary_photo_id)."""
    return photos.join(members.select(on, "moment_id", "primary_photo_id"), on, "left").where(F.col("primary_photo_id").isNull() | (F.col("primary_photo_id") == F.col(on)))


def having_all(df: DataFrame, key: str, value: str, wanted: Sequence) -> DataFrame:
    """The keys that have every wanted value."""
    return df.where(F.col(value).isin(list(wanted))).groupBy(key).agg(F.count_distinct(value).alias("n")).where(F.col("n") == len(set(wanted))).select(key)


def having_any(df: DataFrame, key: str, value: str, wanted: Sequence[str]) -> DataFrame:
    """The keys that have any wanted value, whatever the case."""
    return df.where(F.lower(value).isin([w.lower() for w in wanted])).select(key).distinct()


def in_interval(points: DataFrame, spans: DataFrame, at: str, begin: str, end: str, width: Column | float) -> DataFrame:
    """Every pair of a point and a span that holds it (begin <= at <= end), as an equi-join on buckets.

    ``at``, ``begin`` and ``end`` are numbers (use unix seconds of times); a bucket is ``width`` long, best about a
    usual span's length. A span is sent to each bucket it reaches, a point to one. Null ends hold nothing.
    """
    width = width if isinstance(width, Column) else F.lit(float(width))
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    p = points.withColumn("_bucket", bucket(at))
    s = spans.where(F.col(begin) <= F.col(end)).withColumn("_bucket", F.explode(F.sequence(bucket(begin), bucket(end))))
    return p.join(s, "_bucket").where((F.col(at) >= F.col(begin)) & (F.col(at) <= F.col(end))).drop("_bucket")


def first_interval(points: DataFrame, spans: DataFrame, at: str, begin: str, end: str, width: Column | float, key: str, order: Sequence[str], take: str) -> DataFrame:
    """(key, take): the span that comes first in ``order`` of those that hold the point."""
    return in_interval(points, spans, at, begin, end, width).groupBy(key).agg(F.min_by(take, F.struct(*order)).alias(take))


def band_pairs(df: DataFrame, at: str, key: str, width: float, carry: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Pairs (a, b) with 0 <= b.at - a.at <= width, a before b by (at, key), as an equi-join on buckets of that width.

    A row is sent to its own bucket as b and to its own and the next as a. Carried columns get the suffixes _a and _b.
    """
    bucket = F.floor(F.col(at) / width).cast("long")
    side = lambda s: df.select(*by, F.col(key).alias(f"{key}_{s}"), F.col(at).alias(f"{at}_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in carry], bucket.alias("_own"))
    a = side("a").withColumn("_bucket", F.explode(F.array(F.col("_own"), F.col("_own") + 1))).drop("_own")
    b = side("b").withColumnRenamed("_own", "_bucket")
    gap = F.col(f"{at}_b") - F.col(f"{at}_a")
    return a.join(b, [*by, "_bucket"]).where((gap >= 0) & (gap <= width) & ((gap > 0) | (F.col(f"{key}_a") < F.col(f"{key}_b")))).drop("_bucket")


#: How much longer a way over the sphere can be than ``equirect_km`` says, near the poles.
FLAT_SLACK = 1.17


def _plane_cells(lat: Column, lon: Column, reach: float, around: bool) -> list[Column]:
    """A point's cell of ``2 * reach`` degrees, or all cells within ``reach`` of it: two at most an axis."""
    return [_cells(c, reach, around) for c in (lat, lon)]


def _sphere_cells(lat: Column, lon: Column, reach: float, around: bool) -> list[Column]:
    """The same in space, in metres: cells know no poles and no date line."""
    y, x = F.radians(lat), F.radians(lon)
    return [_cells(c * EARTH_M, reach, around) for c in (F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y))]


def _cells(c: Column, reach: float, around: bool) -> Column:
    at = lambda v: F.floor(v / (2 * reach)).cast("long")
    return F.explode(F.sequence(at(c - reach), at(c + reach))) if around else at(c)


def nearest_within(points: DataFrame, places: DataFrame, *, key: str, lat: str, lon: str, place_lat: str, place_lon: str, limit: float | str, measure: str, strict: bool, order: Sequence[str], take: str, digits: int = 9) -> DataFrame:
    """(key, take): the nearest place closer than ``limit`` (or as close, unless ``strict``), the first in ``order`` on ties.

    ``measure`` is "degrees" (in the plane), "flat" (metres by ``equirect_km``, in which places across the date line are far)
    or "arc" (metres over the sphere), rounded to ``digits``. ``limit`` is a number or a column of ``places``. A point goes
    to its own cell, a place to all cells within the greatest limit: two an axis of the plane, or of space for the measures
    in metres, so that cells are right at any latitude. Nulls are near nothing.
    """
    held = places.where(F.col(place_lat).isNotNull() & F.col(place_lon).isNotNull())
    most = held.agg(F.max(limit)).first()[0] if isinstance(limit, str) else limit
    reach = max(float(most or 0), 1e-6) * (FLAT_SLACK if measure == "flat" else 1.0 + 1e-6)
    ends = F.col(lat), F.col(lon), F.col(place_lat), F.col(place_lon)
    distance = {"degrees": lambda: degrees_apart(*ends), "flat": lambda: 1000 * equirect_km(*ends), "arc": lambda: haversine_m(*ends)}[measure]()
    cells = _plane_cells if measure == "degrees" else _sphere_cells
    axes = ["_x", "_y", "_z"][: 2 if measure == "degrees" else 3]
    p, near = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()), held
    for name, own in zip(axes, cells(F.col(lat), F.col(lon), reach, False), strict=True):
        p = p.withColumn(name, own)
    for name, some in zip(axes, cells(F.col(place_lat), F.col(place_lon), reach, True), strict=True):
        near = near.withColumn(name, some)
    top = F.col(limit) if isinstance(limit, str) else F.lit(float(limit))
    pairs = p.join(near, axes).withColumn("_d", F.round(distance, digits))
    pairs = pairs.where(F.col("_d") < top if strict else F.col("_d") <= top)
    return pairs.groupBy(key).agg(F.min_by(take, F.struct(F.col("_d"), *order)).alias(take))


def shares_identity(a: Column, b: Column, cosine: Column | float = 0.55) -> Column:
    """Both photos without faces, or some face of a and of b with a dot product of 0.55 or more. Arrays of unit vectors."""
    from lumiquarry.functions.vec import dot

    none = lambda x: F.coalesce(F.size(x), F.lit(0)) <= 0
    any_ = F.exists(a, lambda x: F.exists(b, lambda y: dot(x, y) >= cosine))
    return F.when(none(a) & none(b), True).when(none(a) | none(b), False).otherwise(any_)


def best_overlap(stored: DataFrame, detected: DataFrame, by: str, stored_key: str, detected_key: str, least: float = 0.3) -> DataFrame:
    """(by, stored_key, detected_key, iou): the detected box of a photo that overlaps a stored one most, by ``least`` or more."""
    from lumiquarry.functions.vec import iou

    box = ["bbox_x", "bbox_y", "bbox_w", "bbox_h"]
    d = detected.select(by, detected_key, *[F.col(c).alias(f"d_{c}") for c in box])
    pairs = stored.select(by, stored_key, *box).join(d, by)
    pairs = pairs.withColumn("iou", iou(*[F.col(c).cast("double") for c in box], *[F.col(f"d_{c}").cast("double") for c in box])).where(F.col("iou") >= least)
    return pairs.groupBy(by, stored_key).agg(F.max_by(detected_key, F.struct("iou", -F.col(detected_key))).alias(detected_key), F.max("iou").alias("iou"))

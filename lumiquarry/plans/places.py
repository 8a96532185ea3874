"""Names and summaries of places: cache, then landmarks, then a look-up whose answers, also the empty ones, are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiquarry.functions.texts import geo_key, place_name, trim_summary
from lumiquarry.operators.joins import nearest_within
from lumiquarry.session import written

# A landmark's radius where it has none, and the most it counts for, in metres; the name of a place without one.
RADIUS, UNKNOWN = 1500.0, "Unknown location"
#: A summary of fewer characters says nothing.
LEAST_SUMMARY = 21


def resolved(points: DataFrame, cache: DataFrame, landmarks: DataFrame, look_up: Callable[[DataFrame], DataFrame] | None = None, *, key: str = "photo_id") -> tuple[DataFrame, DataFrame]:
    """Names (key, display_name, source) of points (key, lat, lon), and the rows that the cache gains (lat_round, lon_round, payload, display_name).

    Places count by three digits. A place in ``cache`` (lat_round, lon_round, display_name) has its name, one cached without
    a name is unknown. Any other is named once, from its first point: by the nearest landmark (name, lat, lon, radius_m)
    within its radius, else by ``look_up``, which is asked for (lat_round, lon_round, lat, lon) and gives (lat_round,
    lon_round, payload): a payload that is null, or missing, is an unknown place, and is kept as one. Without ``look_up``
    such places have no name and are not kept. Points without a place are in neither table.
    """
    at = ["lat_round", "lon_round"]
    p = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(key, "lat", "lon", geo_key(F.col("lat")).alias("lat_round"), geo_key(F.col("lon")).alias("lon_round"))
    held = cache.groupBy(*at).agg(F.first("display_name").alias("cached"), F.lit(True).alias("known"))
    first = p.groupBy(*at).agg(F.min_by(F.struct("lat", "lon"), F.col(key)).alias("p")).select(*at, "p.lat", "p.lon")
    cells = written(first.join(held, at, "left").withColumn("cell", F.struct(*at)), "cells")
    new = cells.where(F.col("known").isNull()).select("cell", *at, "lat", "lon")
    marks = landmarks.select("name", F.col("lat").alias("mark_lat"), F.col("lon").alias("mark_lon"), F.least(F.coalesce(F.when(F.col("radius_m") != 0, F.col("radius_m")), F.lit(RADIUS)), F.lit(RADIUS)).alias("radius"))
    near = nearest_within(new, marks, key="cell", lat="lat", lon="lon", place_lat="mark_lat", place_lon="mark_lon", limit="radius", measure="flat", strict=False, order=["name"], take="name").withColumnRenamed("name", "mark")
    tried = written(new.join(near, "cell", "left"), "landmarks")
    asked = tried.where(F.col("mark").isNull()).select(*at, "lat", "lon")
    answers = asked.select(*at, F.lit(None).cast("string").alias("payload")).where("false") if look_up is None else look_up(asked).groupBy(*at).agg(F.first("payload").alias("payload"))
    told = tried.select(*at, "mark").join(answers, at, "left")
    name = F.coalesce("mark", F.when(F.col("payload").isNotNull(), place_name(F.col("payload"))), F.lit(UNKNOWN) if look_up else F.lit(None).cast("string"))
    found = written(told.select(*at, "payload", name.alias("display_name"), F.when(F.col("mark").isNotNull(), "landmark").otherwise("look-up").alias("source")), "places")
    gained = found.where(F.col("display_name").isNotNull())
    every = gained.select(*at, "display_name", "source").union(cells.where("known").select(*at, F.coalesce("cached", F.lit(UNKNOWN)), F.lit("cache")))
    return p.join(every, at, "left").select(key, "display_name", "source"), gained.select(*at, "payload", "display_name")


def summary(title: Column, direct: Column, found: Column) -> Column:
    """A place's summary: of the article of that very title, else of the first one found whose title holds it, whatever the case.

    ``direct`` is the article as JSON (type, extract), ``found`` an array of (title, payload) in the order of a search. Pages
    that only list others, and extracts of up to 20 characters, are passed over; what is taken is cut to whole sentences.
    """

    def told(payload: Column) -> Column:
        extract = F.trim(F.get_json_object(payload, "$.extract"))
        listing = F.coalesce(F.get_json_object(payload, "$.type") == "disambiguation", F.lit(False))
        return F.when(~listing & (F.length(extract) >= LEAST_SUMMARY), trim_summary(extract))

    fits = F.filter(found, lambda x: F.contains(F.lower(x["title"]), F.lower(title)))
    others = F.filter(F.transform(fits, lambda x: told(x["payload"])), lambda s: s.isNotNull())
    return F.coalesce(told(direct), F.get(others, F.lit(0)))

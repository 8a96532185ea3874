"""Runs of rows in order, cut by gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiquarry.functions.geo import haversine_km, haversine_m
from lumiquarry.functions.vec import cosine
from lumiquarry.operators.scan import Prev, numbered
from lumiquarry.session import written


def scenes(df: DataFrame, by: Sequence[str], at: str, vector: str, key: str, *, gap: float = 600, similar: float = 0.75, name: str = "scene") -> DataFrame:
    """A new scene where more than ``gap`` seconds lie between neighbours and they are less than ``similar``, both."""
    new = lambda prev: (F.col(at) - prev(at) > gap) & (cosine(F.col(vector), prev(vector), add=0.0) < similar)
    return numbered(df, by, at, key, [at, vector], new, name)


def sessions(df: DataFrame, by: Sequence[str], at: str, lat: str, lon: str, key: str, *, gap: float = 5400, metres: float = 500, name: str = "block") -> DataFrame:
    """A new block after more than ``gap`` seconds or, where both have a latitude, more than ``metres``. Rows without a time come last and no time cuts them."""

    def new(prev: Prev) -> Column:
        late = F.coalesce(F.col(at) - prev(at) > gap, F.lit(False))
        return late | F.coalesce(haversine_m(prev(lat), prev(lon), F.col(lat), F.col(lon)) > metres, F.lit(False))

    return numbered(df, by, at, key, [at, lat, lon], new, name, nulls_last=True)


def route_km(df: DataFrame, by: Sequence[str], order: Sequence[str], lat: str, lon: str) -> DataFrame:
    """(by, km): the length of the way through the points in order; null with fewer than two."""
    w = Window.partitionBy(*by).orderBy(*order)
    leg = haversine_km(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    return df.withColumn("_leg", leg).groupBy(*by).agg(F.sum("_leg").alias("km"))


def whole_route_km(df: DataFrame, order: Sequence[str], lat: str, lon: str) -> DataFrame:
    """W9 of one route, however long: (km,). Ranges of the order are measured on their own; the gaps between them have a row a range."""
    cut = written(df.select(*order, F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "route")
    inner = route_km(cut, ["_part"], order, "_lat", "_lon").agg(F.sum("km").alias("km"), F.count("km").alias("_legs"))
    place, at = F.struct("_lat", "_lon"), F.struct(*order)
    ends = cut.groupBy("_part").agg(F.min_by(place, at).alias("a"), F.max_by(place, at).alias("b"))
    before = F.lag("b").over(Window.orderBy("_part"))
    gaps = ends.select(haversine_km(before["_lat"], before["_lon"], F.col("a")["_lat"], F.col("a")["_lon"]).alias("g")).agg(F.sum("g").alias("g"))
    return inner.join(gaps, F.lit(True)).select(F.when((F.col("_legs") > 0) | F.col("g").isNotNull(), F.coalesce("km", F.lit(0.0)) + F.coalesce("g", F.lit(0.0))).alias("km"))


def good_runs(df: DataFrame, by: Sequence[str], at: str, good: str, least: int = 2) -> DataFrame:
    """(by, start, end, frames) of each run of ``least`` good frames or more, times to three digits. A null is not good."""
    rows = df.select(*by, at, F.coalesce(good, F.lit(False)).alias("_good"))
    runs = numbered(rows, by, at, at, ["_good"], lambda prev: F.col("_good") != prev("_good"), "_run").where("_good")
    out = runs.groupBy(*by, "_run").agg(F.round(F.min(at), 3).alias("start"), F.round(F.max(at), 3).alias("end"), F.count("*").alias("frames"))
    return out.where(F.col("frames") >= least).drop("_run")

"""JSON beside the photos, the geocode cache, and several libraries as one table."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiquarry.functions.texts import geo_key
from lumiquarry.session import written

log = logging.getLogger(__name__)


def keyword_map(text: str | None, default: dict[str, list[str]]) -> dict[str, list[str]]:
    """{label: [word]} from a JSON text; the default where it is missing, broken, of another shape or empty."""
    try:
        got = json.loads(text or "")
    except ValueError:
        return default
    good = isinstance(got, dict) and got and all(isinstance(k, str) and isinstance(v, list) and all(isinstance(x, str) for x in v) for k, v in got.items())
    return got if good else default


def landmarks(spark: SparkSession, path: str) -> DataFrame:
    """(name, lat, lon, radius_m) of a JSON array; entries without name or place are left out, a missing file has none."""
    schema = "name string, lat double, lon double, radius_m double"
    try:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.where("name is not null and lat is not null and lon is not null")


def captions(files: DataFrame) -> DataFrame:
    """(day, caption, hashtags) of (day, text) rows; text that is no such JSON gives an empty caption."""
    c = F.from_json("text", "caption string, hashtags array<string>")
    return files.select("day", F.coalesce(c["caption"], F.lit("")).alias("caption"), F.coalesce(c["hashtags"], F.array().cast("array<string>")).alias("hashtags"))


def geocoded(points: DataFrame, cache: DataFrame) -> DataFrame:
    """Points with display_name from the cache by rounded place (a cached null is an answer), and ``asked`` where the cache has none."""
    c = cache.select(F.col("lat_round").alias("_lat"), F.col("lon_round").alias("_lon"), "display_name", F.lit(False).alias("asked"))
    keyed = points.withColumns({"_lat": geo_key(F.col("lat")), "_lon": geo_key(F.col("lon"))})
    return keyed.join(c, ["_lat", "_lon"], "left").withColumn("asked", F.coalesce("asked", F.lit(True))).drop("_lat", "_lon")


def libraries(spark: SparkSession, registry: list[dict], read: Callable[[SparkSession, str], DataFrame], schema: str) -> DataFrame:
    """The rows of all libraries with library_id; one that cannot be read, to its last row, has none.

    Reading is lazy and a fault may lie anywhere, so each library is copied to the shared folder once. Whatever fails then,
    a missing column or a broken file, leaves that library out and logs its id.
    """
    parts = [spark.createDataFrame([], f"library_id string, {schema}")]
    for lib in registry:
        try:
            rows = read(spark, lib["path"]).select(F.lit(lib["id"]).alias("library_id"), *[c for c in parts[0].columns if c != "library_id"])
            parts.append(written(rows, "library"))
        except Exception:  # a scan of many libraries outlives any one of them
            log.warning("library %s cannot be read", lib["id"], exc_info=True)
    return reduce(DataFrame.unionByName, parts)

"""Bursts of like photos."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiquarry.functions.geo import degrees_apart
from lumiquarry.functions.vec import dot
from lumiquarry.operators.graph import connected_components
from lumiquarry.operators.joins import band_pairs, shares_identity
from lumiquarry.operators.sweep import band_links

# Seconds, degrees, similarity.
SECONDS, DEGREES, SIMILAR = 12, 0.0002, 0.96


def burst_edges(photos: DataFrame, *, seconds: float = SECONDS, similar: float = SIMILAR) -> DataFrame:
    """(a, b) of photos within ``seconds``, near where both have a place, alike, and with a face in common. ``photos``: photo_id, at (seconds), lat, lon, v (unit vector), faces (array of unit vectors)."""
    pairs = band_pairs(photos, "at", "photo_id", seconds, ["lat", "lon", "v", "faces"])
    near = F.coalesce(degrees_apart(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= DEGREES, F.lit(True))
    pairs = pairs.where(near).where(dot(F.col("v_a"), F.col("v_b")) >= similar).where(shares_identity(F.col("faces_a"), F.col("faces_b")))
    return pairs.select(F.col("photo_id_a").alias("a"), F.col("photo_id_b").alias("b"))


def burst_links(photos: DataFrame, *, seconds: float = SECONDS, similar: float = SIMILAR) -> DataFrame:
    """(a, b): links with the components of ``burst_edges``, a forest of each window instead of every pair; ``v`` need not be of unit length."""
    return band_links(photos, at="at", key="photo_id", width=seconds, similar=similar, degrees=DEGREES)


def burst_members(photos: DataFrame, edges: DataFrame) -> DataFrame:
    """(moment_id, photo_id, rank): components of two or more, the best first. ``photos``: photo_id, at, iqa, blur."""
    members = connected_components(edges, "a", "b").select(F.col("node").alias("photo_id"), F.col("component").alias("moment_id"))
    score = 0.6 * F.coalesce("iqa", F.lit(0.0)) + 0.4 * F.least(F.coalesce("blur", F.lit(0.0)) / 1000, F.lit(1.0))
    rows = members.join(photos.select("photo_id", "at", score.alias("_score")), "photo_id")
    rank = F.row_number().over(Window.partitionBy("moment_id").orderBy(F.desc("_score"), "at", "photo_id")) - 1
    return rows.select("moment_id", "photo_id", rank.alias("rank"), "at")


def burst_moments(members: DataFrame) -> DataFrame:
    """(moment_id, primary_photo_id, started_at, ended_at, size)."""
    return members.groupBy("moment_id").agg(F.min_by("photo_id", "rank").alias("primary_photo_id"), F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count("*").alias("size"))

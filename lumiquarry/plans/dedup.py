"""Duplicate reports within libraries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiquarry.functions.vec import once, unit
from lumiquarry.operators.aggregate import exact_duplicates
from lumiquarry.operators.graph import connected_components
from lumiquarry.operators.pivots import TILE, near_rows

#: The similarity from which photos are near duplicates, whatever greater threshold is asked for; that of appearance; photos of a library.
CEILING, APPEARANCE, MOST = 0.92, 0.93, 4000


def near_pairs(photos: DataFrame, threshold: float = 0.97, *, key: str = "photo_id", vector: str = "embedding", appearance: str | None = None, by: Sequence[str] = (), most: int | None = MOST, block: int = TILE) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of one library with a cosine of min(threshold, 0.92) or more, and an appearance correlation of 0.93.

    Libraries of more than ``most`` photos are skipped, as the all-pairs rule is meant for small ones; ``most=None`` takes
    all. Rows are tiled around pivots, and tiles that the triangle inequality keeps apart are not multiplied: see
    ``pivots.near_rows``. Null and zero vectors, and rows of no library, are in no pair.
    """
    groups = [f"by{k}" for k in range(len(by))]
    look = unit(_centred(F.col(appearance))) if appearance else F.lit(None).cast("array<double>")
    rows = photos.where(F.col(vector).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col(key).alias("id"), unit(F.col(vector)).alias("v"), look.alias("look"))
    if most is not None:
        n = F.count("*").alias("n")
        rows = (rows.join(rows.groupBy(*groups).agg(n), groups) if groups else rows.join(F.broadcast(rows.agg(n)), F.lit(True))).where(F.col("n") <= most).drop("n")
    return near_rows(rows, min(threshold, CEILING), by=groups, look="look", alike=APPEARANCE, size=block)


def _centred(v):
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)
    return once(mean, lambda m: F.transform(v, lambda x: x.cast("double") - m))


def near_groups(photos: DataFrame, pairs: DataFrame, *, key: str = "photo_id") -> DataFrame:
    """(group_id, n, keeper, reclaimable) of the components of pairs; ``photos`` has key, iqa and size_bytes."""
    members = connected_components(pairs, "a", "b").select(F.col("node").alias(key), F.col("component").alias("group_id"))
    rows = photos.select(key, "iqa", "size_bytes").join(members, key)
    place = F.struct(F.coalesce(F.col("iqa").cast("double"), F.lit(float("-inf"))), F.coalesce(F.col("size_bytes").cast("long"), F.lit(0)), -F.col(key))
    size = F.coalesce(F.col("size_bytes").cast("long"), F.lit(0))
    return rows.groupBy("group_id").agg(F.count("*").alias("n"), F.max_by(key, place).alias("keeper"), (F.sum(size) - F.max_by(size, place)).alias("reclaimable"))


def report(photos: DataFrame, threshold: float = 0.97, *, key: str = "photo_id", appearance: str | None = None, by: Sequence[str] = (), most: int | None = MOST) -> DataFrame:
    """(kind, groups, photos, reclaimable) of exact and near groups; members of exact groups are no candidates for near ones. ``most`` is that of ``near_pairs``."""
    exact = exact_duplicates(photos, "sha256", key, F.col("iqa"), F.col("size_bytes"))
    rest = photos.join(exact.select("sha256"), "sha256", "left_anti")
    near = near_groups(rest, near_pairs(rest, threshold, key=key, appearance=appearance, by=by, most=most), key=key)
    both = exact.select(F.lit("exact").alias("kind"), "n", "reclaimable").union(near.select(F.lit("near"), "n", "reclaimable"))
    return both.groupBy("kind").agg(F.count("*").alias("groups"), F.sum("n").alias("photos"), F.sum("reclaimable").alias("reclaimable"))

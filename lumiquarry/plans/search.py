"""Nearest photos to a query vector, and their mixture with tag hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiquarry.functions.texts import either_contains
from lumiquarry.functions.vec import cosine

# Bonus of the first tag hit and of each further one, share of the best similarity that is kept, least number of hits.
BONUS, STEP, KEEP, LEAST = 10.0, 1.0, 0.55, 12


def query_vector(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def top_k(photos: DataFrame, vector: Sequence[float], k: int = 60, *, key: str = "photo_id", embedding: str = "embedding") -> DataFrame:
    """T4: (key, similarity) of the ``k`` (300 at most) rows most like the vector. A take-ordered plan: each task sends k rows."""
    near = cosine(F.col(embedding), query_vector(vector))
    return photos.select(key, near.alias("similarity")).orderBy(F.desc("similarity"), key).limit(min(k, 300))


def restricted(photos: DataFrame, *filters: DataFrame | None, key: str = "photo_id") -> DataFrame:
    """The photos that are in every filter given; an empty filter empties, a missing one does not restrict."""
    for f in filters:
        if f is not None:
            photos = photos.join(f.select(key), key, "left_semi")
    return photos


def tag_hits(tags: DataFrame, words: Sequence[str], *, key: str = "photo_id", tag: str = "tag") -> DataFrame:
    """(key, hits): pairs of a word and a tag row of which either is within the other."""
    text = F.lower(tag)
    hits = F.size(F.filter(F.array(*[F.lit(w) for w in words]).cast("array<string>"), lambda w: either_contains(text, w)))
    return tags.groupBy(key).agg(F.sum(hits).alias("hits")).where("hits > 0")


def hybrid(photos: DataFrame, tags: DataFrame, words: Sequence[str], vector: Sequence[float], *, limit: int = 60, key: str = "photo_id", embedding: str = "embedding") -> DataFrame:
    """(key, semantic, hits, score): similarity, and 10 + (hits - 1) where tags hit.

    Kept are hits and what reaches 0.55 of the best similarity, if that is positive; with fewer than 12 of these, the top
    12. Photos without a vector are out. Row numbers are taken of at most ``limit`` + 12 rows.
    """
    rows = photos.where(F.col(embedding).isNotNull()).select(key, cosine(F.col(embedding), query_vector(vector)).alias("semantic"))
    rows = rows.join(tag_hits(tags, words, key=key), key, "left").fillna(0, ["hits"])
    rows = rows.withColumn("score", F.col("semantic") + F.when(F.col("hits") > 0, BONUS + STEP * (F.col("hits") - 1)).otherwise(0.0))
    best = rows.agg(F.max("semantic").alias("_best"))
    rows = rows.join(F.broadcast(best), F.lit(True)).withColumn("_keep", (F.col("hits") > 0) | (F.col("_best") <= 0) | (F.col("semantic") >= KEEP * F.col("_best")))
    order = [F.desc("score"), F.col(key)]
    # What is kept is a head of the order, as hits outrank the rest: the greater of the two heads is the result.
    head = rows.orderBy(*order).limit(max(limit, LEAST)).withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    return head.where((F.col("_keep") | (F.col("_at") <= LEAST)) & (F.col("_at") <= limit)).select(key, "semantic", "hits", "score")


def stories_like(items: DataFrame, vector: Sequence[float], *, story: str = "story_id", key: str = "photo_id", embedding: str = "embedding", least: float = 0.03) -> DataFrame:
    """Items of stories of which one is like the vector by ``least``: (story, key, similarity, best); no vector is -1."""
    near = F.coalesce(cosine(F.col(embedding), query_vector(vector)), F.lit(-1.0))
    out = items.select(story, key, near.alias("similarity"))
    best = out.groupBy(story).agg(F.max("similarity").alias("best")).where(F.col("best") >= least)
    return out.join(best, story)

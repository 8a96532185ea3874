"""Roll-ups of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiquarry.operators.rank import running_total, top_per_group


def facet_counts(**facets: DataFrame) -> DataFrame:
    """A4: (facet, value, n): the counts of each frame's only column, nulls out."""
    out = None
    for name, df in facets.items():
        (c,) = df.columns
        part = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("facet"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def map_bins(df: DataFrame, lat: str, lon: str, grid: float, cover: str, latest: Sequence[str]) -> DataFrame:
    """Cells of ``grid`` degrees, rounded half to even: count, mean place, and ``cover`` of the latest row (nulls least)."""
    cell = lambda c: F.bround(F.col(c) / grid, 0).cast("long")
    keyed = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumns({"cell_lat": cell(lat), "cell_lon": cell(lon)})
    return keyed.groupBy("cell_lat", "cell_lon").agg(F.count("*").alias("n"), F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.max_by(cover, F.struct(*latest)).alias("cover"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """(bin, n) of equal widths from least to greatest, the last bin closed; one value falls in bin 0."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0))))).otherwise(0)
    return df.where(F.col(value).isNotNull()).join(F.broadcast(ends), F.lit(True)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def pearson(x: Column, y: Column) -> Column:
    """Over the rows that have both; 0 where one does not vary."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(flat | (F.count(x) == 0), 0.0).otherwise(F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def mean_vectors(df: DataFrame, by: Sequence[str], vector: str, *, unit: bool = True) -> DataFrame:
    """(by, centroid, n): the mean of a group's vectors, of length 1 unless ``unit`` is off or it is zero.

    Components are averaged one by one, so partial sums are as long as a vector whatever the group.
    """
    parts = df.select(*by, F.posexplode(vector).alias("_at", "_x")).groupBy(*by, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_x"), F.count("*").alias("_n"))
    out = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias("centroid"), F.max("_n").alias("n"))
    if not unit:
        return out
    size = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x * x))
    return out.withColumn("centroid", F.when(size > 0, F.transform("centroid", lambda x: x / size)).otherwise(F.col("centroid")))


def exact_duplicates(df: DataFrame, digest: str, key: str, score: Column, size: Column) -> DataFrame:
    """(digest, n, keeper, reclaimable): groups of two or more with one digest; the best score, then size, then the least key is kept.

    Empty and null digests are out.
    """
    place = F.struct(F.coalesce(score.cast("double"), F.lit(float("-inf"))), F.coalesce(size.cast("long"), F.lit(0)), -F.col(key))
    out = df.where(F.col(digest).isNotNull() & (F.col(digest) != "")).groupBy(digest).agg(F.count("*").alias("n"), F.max_by(key, place).alias("keeper"), (F.sum(F.coalesce(size.cast("long"), F.lit(0))) - F.max_by(F.coalesce(size.cast("long"), F.lit(0)), place)).alias("reclaimable"))
    return out.where(F.col("n") >= 2)


def trip_kind(photos: Column, counts: Column) -> Column:
    """From the number of photos and the array of photos per person."""
    floor = F.greatest(F.lit(3), F.floor(photos * 0.05).cast("int"))
    n = F.size(F.filter(counts, lambda c: c >= floor))
    return F.when(n == 0, "unknown").when(n == 1, "solo").when(n == 2, "couple").when(n <= 6, "group").otherwise("event")


def clusters(photos: DataFrame, tags: DataFrame, *, key: str = "photo_id", tag: str = "tag", score: str = "score", quality: str = "iqa", least: int = 1) -> DataFrame:
    """(tag, n, samples, cover): photos by their best tag, with the best four of each, the best as cover; those without any are "uncategorized".

    The four are picked in the tasks before the shuffle, so a hot tag is a count and no sorted group.
    """
    best = tags.groupBy(key).agg(F.min_by(tag, F.struct(-F.col(score), F.col(tag))).alias("tag"))
    rows = photos.select(key, quality).join(best, key, "left").withColumn("tag", F.coalesce("tag", F.lit("uncategorized")))
    four = top_per_group(rows, ["tag"], [F.col(quality).desc_nulls_last(), F.col(key)], 4, rank="_at")
    four = four.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", key))), lambda s: s[key]).alias("samples"))
    counts = rows.groupBy("tag").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(four, "tag").select("tag", "n", "samples", F.get("samples", F.lit(0)).alias("cover"))


def best_faces(faces: DataFrame, person: str = "person_id", face: str = "face_id", *, least_confidence: float = 0.0, least_px: int = 0) -> DataFrame:
    """(person, face, confidence): the face with the greatest confidence times the root of its area, if it passes the gates."""
    best = faces.groupBy(person).agg(F.max_by(F.struct(face, "confidence", "bbox_w", "bbox_h"), F.struct(F.col("confidence") * F.sqrt((F.col("bbox_w") * F.col("bbox_h")).cast("double")), -F.col(face))).alias("f"))
    return best.where((F.col("f.confidence") >= least_confidence) & (F.least("f.bbox_w", "f.bbox_h") >= least_px)).select(person, f"f.{face}", "f.confidence")


def person_tables(faces: DataFrame, *, person: str = "person_id", photo: str = "photo_id", face: str = "face_id", least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Persons (person, cover_face_id, photo_count) on ``least`` photos or more, and their photos (photo, person, face, confidence).

    The cover is a person's surest face, and a photo's face the surest of that person in it; the lesser id on ties. Rows
    without a person are out, a null confidence is the least.
    """
    sure = F.struct(F.coalesce(F.col("confidence").cast("double"), F.lit(float("-inf"))), -F.col(face))
    own = faces.where(F.col(person).isNotNull())
    per = own.groupBy(photo, person).agg(F.max_by(F.struct(face, "confidence"), sure).alias("f")).select(photo, person, f"f.{face}", "f.confidence")
    persons = per.groupBy(person).agg(F.max_by(face, sure).alias("cover_face_id"), F.count("*").alias("photo_count")).where(F.col("photo_count") >= least)
    return persons, per.join(persons.select(person), person, "left_semi").select(photo, person, face, "confidence")


def rank_auc(df: DataFrame, label: Column, score: str) -> DataFrame:
    """(auc,): by average ranks; null with one class. Ranks are running totals of counts per distinct score; rows without a score are out."""
    per = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.count_if(label).alias("pos"))
    ranked = running_total(per, [F.col(score)], F.col("n"), "to").select("n", "pos", (F.col("to") - F.col("n") + (F.col("n") + 1) / 2).alias("rank"))
    return ranked.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("rank") * F.col("pos")).alias("ranks")).select(
        F.try_divide(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos"))).alias("auc")
    )

"""K1 to K8: changes of tables as functions from old rows to new rows, and writers of slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rebuilt(df: DataFrame, path: str) -> None:
    """K1: the table is what ``df`` says."""
    df.write.mode("overwrite").parquet(path)


def slice_replaced(old: DataFrame, new: DataFrame, slice_: Column) -> DataFrame:
    """K2: ``old`` without the rows of the slice, and ``new``. A null test keeps the row."""
    return old.where(~F.coalesce(slice_, F.lit(False))).unionByName(new)


def slices_written(df: DataFrame, path: str, by: str, null: str = "legacy") -> None:
    """K2 on disk: the partitions that ``df`` holds are replaced, the others stay; a null source is the slice ``null``."""
    df.withColumn(by, F.coalesce(by, F.lit(null))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """K3: ``old`` and those of ``new`` (one a key) whose keys it lacks. Null keys never meet."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], seq: str, keep_first: Sequence[str] = ()) -> DataFrame:
    """K4: for each key the row that comes last by ``seq``; columns ``keep_first`` keep the value of the first."""
    w = Window.partitionBy(*keys)
    both = old.unionByName(new)
    both = both.withColumns({c: F.first(c).over(w.orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in keep_first}) if keep_first else both
    return both.withColumn("_at", F.row_number().over(w.orderBy(F.desc(seq)))).where("_at = 1").drop("_at")


def columns_updated(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """K5: the columns take ``new``'s values where it has some."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return old.join(n, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def merged_persons(links: DataFrame, sources: Sequence[int], target: int) -> tuple[DataFrame, DataFrame]:
    """K6: photo_persons with sources as the target, one a photo and person, the higher confidence kept (the target's own on ties); and (person_id, photo_count)."""
    own = (F.col("person_id") == target).cast("int")
    moved = links.withColumn("_own", own).withColumn("person_id", F.when(F.col("person_id").isin(list(sources)), F.lit(target)).otherwise(F.col("person_id")).cast(links.schema["person_id"].dataType))
    best = moved.groupBy("photo_id", "person_id").agg(F.max_by(F.struct("face_embedding_id", "confidence"), F.struct("confidence", "_own", -F.col("face_embedding_id"))).alias("b"))
    out = best.select("photo_id", "person_id", "b.face_embedding_id", "b.confidence")
    return out, out.groupBy("person_id").agg(F.count_distinct("photo_id").alias("photo_count"))


def primary_set(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """K7: in each stack of ``chosen`` (moment_id, photo_id) that photo has rank 0 and the others keep their order; other stacks stay."""
    c = chosen.select("moment_id", F.col("photo_id").alias("_chosen"))
    order = [(F.col("photo_id") != F.coalesce("_chosen", F.lit(-1))).cast("int"), F.col("rank"), F.col("photo_id")]
    return members.join(c, "moment_id", "left").withColumn("rank", F.row_number().over(Window.partitionBy("moment_id").orderBy(*order)) - 1).drop("_chosen")


def label_renamed(stories: DataFrame, old: str, new: str) -> DataFrame:
    """K8: the label within the keys and titles of people stories."""
    people = F.col("day").startswith("people:")
    return stories.withColumns({c: F.when(people, F.replace(F.col(c), F.lit(old), F.lit(new))).otherwise(F.col(c)) for c in ("day", "title")})

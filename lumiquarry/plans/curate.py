"""C14: curation of a scope: gates by percentiles, one photo a stack, taste, order. One plan, whatever the scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiquarry.functions.scores import AP_WEIGHT, NIMA_WEIGHT, blend, taste_weight
from lumiquarry.operators.rank import average_percent, group_elements, linear_place, top_per_group, whole_percentile


def library_floor(photos: DataFrame, percent: float, *, ap_weight: float = AP_WEIGHT, nima_weight: float = NIMA_WEIGHT) -> DataFrame:
    """A5: one row (floor): the library's percentile of the blended scores; null without scored photos."""
    return whole_percentile(photos, blend(F.col("ap25"), F.col("nima"), ap_weight, nima_weight), percent, "floor")


def curate(
    library: DataFrame, scope: DataFrame, *, by: Sequence[str] = (), moments: DataFrame | None = None, penalties: DataFrame | None = None, taste: DataFrame | None = None, taste_samples: int = 0,
    ap_weight: float = AP_WEIGHT, nima_weight: float = NIMA_WEIGHT, percent: float = 75, library_percent: float | None = None, min_keep: int = 1,
) -> DataFrame:
    """The photos of each scope that pass, with combined, moment_id and final.

    ``library`` and ``scope`` have photo_id, ap25, nima (and ``scope`` the columns ``by`` that part it into scopes, of
    which all are curated at once). Photos without both scores are out. The cut is the greater of the scope's percentile
    over the whole scope (none where it has max(1, min_keep) photos or fewer) and the library's, and what equals it stays.
    Where fewer than ``min_keep`` pass, the scope's best ones do, whatever the library's floor. Of the passing photos of a
    stack (``moments``: photo_id, moment_id, primary_photo_id) the primary stays, or else the best after ``penalties``
    (photo_id, penalty). ``taste`` (photo_id, taste) blends with the percentile rank of ``combined`` among what is left.
    """
    scopes = list(by) or ["_scope"]
    df = scope.withColumn("combined", blend(F.col("ap25"), F.col("nima"), ap_weight, nima_weight)).where(F.col("combined").isNotNull())
    if not by:
        df = df.withColumn("_scope", F.lit(0))
    if by:
        cuts = df.groupBy(*scopes).agg(F.count("*").alias("_n")).join(group_elements(df, scopes, "combined", {"_cut": linear_place(percent)}), scopes)
    else:  # one scope may be the whole library
        cuts = df.groupBy("_scope").agg(F.count("*").alias("_n")).join(whole_percentile(df, F.col("combined"), percent, "_cut"), F.lit(True))
    cut = F.when(F.col("_n") > max(1, min_keep), F.col("_cut")).otherwise(F.lit(float("-inf")))
    if library_percent is not None:
        floor = library_floor(library, library_percent, ap_weight=ap_weight, nima_weight=nima_weight)
        cuts = cuts.join(F.broadcast(floor), F.lit(True))
        cut = F.greatest(cut, F.coalesce("floor", F.lit(float("-inf"))))
    cuts = cuts.select(*scopes, cut.alias("_cut"))
    df = df.join(cuts if by else F.broadcast(cuts), scopes)
    if library_percent is not None and min_keep > 0:  # the scope's own percentile never rejects its best row
        short = df.groupBy(*scopes).agg(F.count_if(F.col("combined") >= F.col("_cut")).alias("_passed")).where(F.col("_passed") < min_keep).select(*scopes)
        rescued = top_per_group(df.join(short, scopes, "left_semi"), scopes, [F.desc("combined"), F.col("photo_id")], min_keep)
        df = df.where(F.col("combined") >= F.col("_cut")).join(short, scopes, "left_anti").unionByName(rescued)
    else:
        df = df.where(F.col("combined") >= F.col("_cut"))
    df = df.drop("_cut")
    if moments is not None:
        df = df.join(moments.select("photo_id", "moment_id", "primary_photo_id"), "photo_id", "left")
        penalty: Column = F.lit(0.0)
        if penalties is not None:
            df, penalty = df.join(penalties.select("photo_id", "penalty"), "photo_id", "left"), F.coalesce("penalty", F.lit(0.0))
        first = [F.coalesce((F.col("photo_id") == F.col("primary_photo_id")).cast("int"), F.lit(0)).desc(), (F.col("combined") - penalty).desc(), F.col("photo_id")]
        stack = F.coalesce(F.col("moment_id").cast("string"), F.concat(F.lit("photo "), F.col("photo_id").cast("string")))
        df = df.withColumn("_at", F.row_number().over(Window.partitionBy(*scopes, stack).orderBy(*first))).where("_at = 1").drop("_at", "primary_photo_id", "penalty")
    if taste is not None:
        weight = taste_weight(F.lit(taste_samples))
        df = df.join(taste.select("photo_id", "taste"), "photo_id", "left").withColumn("_rank", average_percent("combined", scopes))
        df = df.withColumn("final", F.when(F.col("taste").isNotNull(), (1 - weight) * F.col("_rank") + weight * F.col("taste")).otherwise(F.col("_rank"))).drop("_rank")
    return df.drop("_scope")


def curated_order(final: bool = False, chronological: bool = False) -> list[Column]:
    if chronological:
        return [F.col("taken_at").asc_nulls_first(), F.col("photo_id")]
    return [F.desc("final" if final else "combined"), F.col("photo_id")]

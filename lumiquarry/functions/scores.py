"""Scores of one row and the predicates on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumiquarry.functions.vec import dot

# Weights, gates and limits of the scoring rules.
AP_WEIGHT, NIMA_WEIGHT = 0.6, 0.4
UNDER_LUMA, OVER_LUMA, OVER_CLIPPED, UNDER_CLIPPED = 0.32, 0.78, 0.07, 0.10
FOCUS_BLUR, KEEPER_BLUR, KEEPER_SCORE = 150, 400, 5.8
REJECT_BLUR, REJECT_CLIPPED, REJECT_EXPOSURE = 30, 0.95, 0.1
TASTE_FROM, TASTE_SPAN, TASTE_MOST = 100, 900, 0.4


def blend(ap: Column, nima: Column, ap_weight: float = AP_WEIGHT, nima_weight: float = NIMA_WEIGHT) -> Column:
    """The weighted sum; null if either is."""
    return ap_weight * ap + nima_weight * nima


def mean_available(*scores: Column) -> Column:
    """The plain mean of the scores that are there; null without any."""
    there = F.filter(F.array(*[s.cast("double") for s in scores]), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))


def rejected_is(wanted: bool | None, rejected: Column, scored: Column) -> Column:
    """Rejected rows, the others (unscored ones too), or all."""
    if wanted is None:
        return F.lit(True)
    return F.coalesce(rejected, F.lit(False)) if wanted else F.coalesce(~rejected, F.lit(False)) | ~scored


def quality_is(bucket: str, luma: Column, clipped_high: Column, blur: Column, ap: Column, nima: Column) -> Column:
    """The list filter of a quality bucket; nulls are out."""
    tests = {
        "under": luma < UNDER_LUMA,
        "over": (luma > OVER_LUMA) | (clipped_high > OVER_CLIPPED),
        "out_of_focus": blur < FOCUS_BLUR,
        "blurry_keepers": (blur >= FOCUS_BLUR) & (blur < KEEPER_BLUR) & (blend(ap, nima) >= KEEPER_SCORE),
    }
    return F.coalesce(tests[bucket], F.lit(False))


def doctor_buckets(luma: Column, clipped_low: Column, clipped_high: Column, blur: Column, ap: Column, nima: Column) -> Column:
    """The buckets a photo is listed in, an array of up to two names. Not the rules of P3: light is under or else over, focus is out or else a keeper."""
    blur, luma = F.coalesce(blur, F.lit(9999.0)), F.coalesce(luma, F.lit(0.5))
    light = F.when((luma < UNDER_LUMA) | F.coalesce(clipped_low > UNDER_CLIPPED, F.lit(False)), "under").when((luma > OVER_LUMA) | F.coalesce(clipped_high > OVER_CLIPPED, F.lit(False)), "over")
    focus = F.when(blur < FOCUS_BLUR, "out_of_focus").when((blur < KEEPER_BLUR) & F.coalesce(blend(ap, nima) >= KEEPER_SCORE, F.lit(False)), "blurry_keepers")
    return F.array_compact(F.array(light, focus))


def reject_reason(blur: Column, clipped: Column, exposure: Column, faces: Column) -> Column:
    """P5: severe_blur, else all_black for a clipped dark frame without faces, else null (kept)."""
    return F.when(blur < REJECT_BLUR, "severe_blur").when((clipped > REJECT_CLIPPED) & (exposure < REJECT_EXPOSURE) & (faces == 0), "all_black")


def sigmoid(z: Column) -> Column:
    """M5, without overflow on either side."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def softmax_first(a: Column, b: Column, *, scale: float = 112.33, bias: float = -16.55) -> Column:
    """M5: the share of the first of two scaled similarities."""
    return sigmoid((a * scale + bias) - (b * scale + bias))


def frame_quality(blur: Column, exposure: Column) -> Column:
    """M9; null without a sharpness."""
    return F.when(blur.isNotNull(), 0.5 * F.least(F.lit(1.0), blur / 200) + 0.5 * exposure)


def frame_good(blur: Column, exposure: Column) -> Column:
    return (blur >= 100) & (exposure >= 0.35)


def dead_footage(good: Column, frames: Column) -> Column:
    """Over seven tenths of the frames are bad; null without frames."""
    return F.when(frames > 0, (frames - good) / frames > 0.70)


def taste_weight(n: Column) -> Column:
    """From 0 at 100 samples to 0.4 at 1000."""
    return TASTE_MOST * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (n - TASTE_FROM) / TASTE_SPAN))


def stage_seconds(photos: Column, gpu: bool = False) -> Column:
    """The planned seconds of indexing, scoring, embedding, tagging and story building."""
    costs = {False: (0.03, 0.12, 0.9, 0.5, 0.02), True: (0.03, 0.08, 0.12, 0.08, 0.02)}[gpu]
    return photos * F.lit(sum(costs))


def prompt_quality(vector: Column, good: Sequence[float], bad: Sequence[float]) -> Column:
    """How much more a unit vector is like the prompt of a good picture than like that of a bad one; 0 to 1, null of a null vector."""
    like = lambda words: dot(vector, F.array(*[F.lit(float(x)) for x in words]))
    return softmax_first(like(good), like(bad))

"""Decoded pictures as rows: previews, measures and corrected pictures, in Arrow batches.

A picture is (key, width, height, pixels): RGB bytes, row by row. Decoders give such rows (``media.inferred``).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiquarry.functions import pixels
from lumiquarry.sources.media import EDGES

MEASURES = "sharpness double, exposure double, luma_mean double, luma_std double, clipped double, clipped_low double, clipped_high double, p05 double, p95 double, low_light boolean"
PICTURE = "width int, height int, pixels binary"


def image(width: int | None, height: int | None, data: bytes | None) -> np.ndarray | None:
    """The picture as (height, width, 3); None where its size and its bytes do not fit."""
    if data is None or not (isinstance(width, (int, np.integer)) and isinstance(height, (int, np.integer))) or width <= 0 or height <= 0 or len(data) != 3 * width * height:
        return None
    return np.frombuffer(data, np.uint8).reshape(int(height), int(width), 3)


def mapped(frames: DataFrame, key: str, of: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """(key, what ``schema`` names): the rows that ``of`` makes of each picture; a row of nulls where there is none."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, w, h, data in zip(b["_key"], b["width"], b["height"], b["pixels"], strict=True):
                w, h = (None if pd.isna(x) else int(x) for x in (w, h))
                rows = of(x) if (x := image(w, h, data)) is not None else [(None,) * len(names)]
                yield pd.DataFrame([(k, *r) for r in rows], columns=["_key", *names], dtype="object")

    kind = frames.schema[key].dataType.simpleString()
    return frames.select(F.col(key).alias("_key"), "width", "height", "pixels").mapInPandas(run, f"_key {kind}, {schema}").withColumnRenamed("_key", key)


def measured(frames: DataFrame, key: str = "path") -> DataFrame:
    """M6: (key, sharpness, exposure, luma_mean, luma_std, clipped, clipped_low, clipped_high, p05, p95, low_light) of each picture; see ``pixels``."""

    def of(x: np.ndarray) -> list[tuple]:
        e, s = pixels.exposure(x), pixels.luma_stats(x)
        return [(pixels.laplacian_variance(x), e["score"], s["mean"], s["std"], e["clipped"], s["clipped_low"], s["clipped_high"], s["p05"], s["p95"], pixels.is_low_light(x))]

    return mapped(frames, key, of, MEASURES)


def toned(frames: DataFrame, key: str = "path") -> DataFrame:
    """(key, width, height, pixels) with the automatic tone."""
    return mapped(frames, key, lambda x: [(x.shape[1], x.shape[0], pixels.auto_tone(x).tobytes())], PICTURE)


def previews(frames: DataFrame, key: str = "path") -> DataFrame:
    """K9: (key, size, width, height, pixels): a thumb and a preview of each picture, long edges as in EDGES, never larger than it was; none of what is no picture."""

    def of(x: np.ndarray) -> list[tuple]:
        out = []
        for size, edge in EDGES.items():
            scale = edge / max(x.shape[:2])
            w, h = (max(1, int(n * scale)) for n in (x.shape[1], x.shape[0])) if scale < 1 else (x.shape[1], x.shape[0])
            out.append((size, w, h, (pixels.lanczos(x, w, h) if scale < 1 else x).tobytes()))
        return out

    return mapped(frames, key, of, f"size string, {PICTURE}").where(F.col("size").isNotNull())


def previews_written(frames: DataFrame, folder: str, key: str = "sha256", encode: Callable[[np.ndarray], bytes] = pixels.png, ending: str = "png") -> DataFrame:
    """K9: (key, size, path): previews written below ``folder``, a mounted one, by ``encode``; PNG unless told otherwise.

    Tasks write beside the place and rename, so that a task that runs again, or two that write the same, leave whole files.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            paths = []
            for k, size, w, h, data in zip(b[key], b["size"], b["width"], b["height"], b["pixels"], strict=True):
                os.makedirs(os.path.join(folder, size), exist_ok=True)
                path = os.path.join(folder, size, f"{k}.{ending}")
                with open(beside := f"{path}.{uuid.uuid4().hex}.tmp", "wb") as f:
                    f.write(encode(image(int(w), int(h), data)))
                os.replace(beside, path)
                paths.append(path)
            yield pd.DataFrame({key: b[key], "size": b["size"], "path": paths})

    kind = frames.schema[key].dataType.simpleString()
    return previews(frames, key).mapInPandas(run, f"{key} {kind}, size string, path string")


def cover(photos: DataFrame, score: Column, thumb: str, key: str = "photo_id", most: int = 25) -> DataFrame:
    """(key, thumb): of the ``most`` best photos (nulls last, the lesser key on ties) the first whose thumb is a file; no row without any.

    The few are looked for in one task, on a machine that has the folder mounted.
    """

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.sort_values("_at")
            hit = next((i for i, path in enumerate(b[thumb]) if isinstance(path, str) and os.path.isfile(path)), None)
            yield b.iloc[[]] if hit is None else b.iloc[[hit]]

    order = [score.desc_nulls_last(), F.col(key)]
    best = photos.select(key, thumb, score.alias("_score")).orderBy(*order).limit(most)
    placed = best.agg(F.collect_list(F.struct(F.col("_score").isNull().alias("late"), (-F.col("_score").cast("double")).alias("low"), key, thumb)).alias("all")).select(F.posexplode(F.array_sort("all")).alias("_at", "x"))
    found = placed.select("_at", f"x.{key}", f"x.{thumb}")
    return found.coalesce(1).mapInPandas(first, found.schema).select(key, thumb)

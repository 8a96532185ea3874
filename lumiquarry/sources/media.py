"""Files of a media folder, what is read from them, and plug-ins for what needs a decoder or a model."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File endings by kind, folders that are passed over, edges of previews.
JPEG = (".jpg", ".jpeg", ".png", ".webp", ".tif", ".tiff", ".bmp", ".gif")
HEIC = (".heic", ".heif")
RAW = (".dng", ".cr2", ".cr3", ".nef", ".arw", ".raf", ".orf", ".rw2", ".pef")
VIDEO = (".mp4", ".mov", ".m4v", ".mkv")
PASSED_OVER = (".git", "__pycache__", "node_modules")
EDGES = {"thumb": 256, "preview": 1024}


def kind(path: Column) -> Column:
    """S3: the kind by ending, whatever its case; null for others."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(ending.isin(list(JPEG)), "jpeg").when(ending.isin(list(HEIC)), "heic").when(ending.isin(list(RAW)), "raw").when(ending.isin(list(VIDEO)), "video")


def listed(spark: SparkSession, root: str, parts: int = 8, state_folder: str = ".lumiquarry") -> DataFrame:
    """(path, kind, size_bytes, mtime) of the media files below ``root``; names that begin with "_" or "." count, some folders and the library's own ``state_folder`` don't.

    Spark's own file sources hide such names, so folders that all machines mount are walked: the driver lists ``root``
    itself, tasks walk the folders in it. Folders that cannot be read, and names that go while they are read, are left out.
    """

    def below(names: list[str]) -> list[str]:
        return [d for d in names if d not in PASSED_OVER and d != state_folder]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for top, deep in zip(b["folder"], b["deep"], strict=True):
                for folder, folders, names in os.walk(top):
                    folders[:] = below(folders) if deep else []
                    for at in range(0, len(names), 10_000):
                        yield _stats([os.path.join(folder, n) for n in names[at : at + 10_000]])

    first = below(next(os.walk(root), (root, [], []))[1])
    folders = [(os.path.join(root, d), True) for d in sorted(first)]
    found = spark.createDataFrame([(root, False), *folders], "folder string, deep boolean").repartition(parts).mapInPandas(walk, FILES)
    return found.withColumn("kind", kind(F.col("path"))).where("kind is not null")


FILES = "path string, size_bytes long, mtime double"


def _stats(paths: list[str]) -> pd.DataFrame:
    """(path, size_bytes, mtime) of the paths that are files."""
    rows = []
    for p in paths:
        try:
            s = os.stat(p)
        except OSError:
            continue
        if stat.S_ISREG(s.st_mode):
            rows.append((p, s.st_size, s.st_mtime))
    return pd.DataFrame({"path": pd.Series([r[0] for r in rows], dtype="object"), "size_bytes": pd.Series([r[1] for r in rows], dtype="int64"), "mtime": pd.Series([r[2] for r in rows], dtype="float64")})


def of_paths(spark: SparkSession, paths: list[str], parts: int = 8) -> DataFrame:
    """(path, kind, size_bytes, mtime) of those paths that are media files; a path that is no file is dropped."""

    names = spark.createDataFrame([(p,) for p in paths], "path string").repartition(parts).withColumn("kind", kind(F.col("path"))).where("kind is not null").select("path")
    return names.mapInPandas(lambda batches: (_stats(b["path"].tolist()) for b in batches), FILES).withColumn("kind", kind(F.col("path")))


def hashed(files: DataFrame, piece: int = 1 << 20) -> DataFrame:
    """``files`` (path, ...) with sha256, read in pieces of a fixed size, so that a video of any length has its hash; null where it cannot be read."""

    def digest(path: str) -> str | None:
        own = hashlib.sha256()
        try:
            with open(path, "rb") as f:
                while part := f.read(piece):
                    own.update(part)
        except OSError:
            return None
        return own.hexdigest()

    schema = files.drop("sha256").select("*", F.lit(None).cast("string").alias("sha256")).schema
    return files.drop("sha256").mapInPandas(lambda batches: (b.assign(sha256=pd.Series([digest(p) for p in b["path"]], dtype="object", index=b.index)) for b in batches), schema)


def frame_indices(count: Column, fps: Column, n: int = 12) -> Column:
    """The frames to take: min(n, count) evenly from first to last, rounded half to even; of an unknown count null (the reader strides by ``stride``)."""
    m = F.least(F.lit(n), count)
    step = F.when(m > 1, (count - 1) / F.nullif(m - 1, F.lit(0))).otherwise(0.0)
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), m - 1), lambda k: F.bround(k * step, 0).cast("int"))))


def stride(fps: Column) -> Column:
    """Frames between samples where the count is unknown: one a second."""
    whole = F.coalesce(fps, F.lit(0.0)).cast("int")
    return F.greatest(F.lit(1), F.when(whole != 0, whole).otherwise(30))


def preview_size(width: Column, height: Column, edge: int) -> Column:
    """K9: width and height with the long edge at most ``edge``, cut to whole pixels, never larger than before."""
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height))
    cut = lambda c: F.greatest(F.lit(1), (c * scale).cast("int"))
    return F.struct(cut(width).alias("width"), cut(height).alias("height"))


def inferred(files: DataFrame, model: Callable[[list[bytes]], list], schema: str, *, key: str = "path", content: str = "content", batch: int = 16) -> DataFrame:
    """(key, what ``schema`` names): a decoder or model over batches of file contents, in Arrow batches.

    ``model`` gives a tuple for each content, or None where it cannot be read: such a row has nulls. It stands for image
    and video decoders and for embedding, tagging and face models, none of which is part of the library.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                rows = [r if r is not None else (None,) * len(names) for r in model([bytes(x) for x in part[content]])]
                yield pd.DataFrame([[k, *r] for k, r in zip(part[key], rows, strict=True)], columns=[key, *names])

    return files.select(key, content).mapInPandas(run, f"{key} string, {schema}")


def faces_of(found: DataFrame, key: str = "path", faces: str = "faces") -> DataFrame:
    """(key, face_index, and the fields of a face) of what a face model found (``inferred``): a row a face, none of a picture without any."""
    rows = found.select(key, F.posexplode(faces).alias("face_index", "_face"))
    return rows.select(key, "face_index", "_face.*")


def top_tags(logits: DataFrame, thresholds: DataFrame, dropped: list[str], n: int = 15) -> DataFrame:
    """(photo_id, tags): classes over their thresholds, trimmed and lower case, without the dropped ones, the first ``n`` by class number. ``logits``: photo_id, logits (array); ``thresholds``: class, tag, threshold."""
    rows = logits.select("photo_id", F.posexplode("logits").alias("class", "x")).join(F.broadcast(thresholds), "class")
    rows = rows.where(1 / (1 + F.exp(-F.col("x"))) > F.col("threshold")).withColumn("tag", F.lower(F.trim("tag"))).where(~F.col("tag").isin(dropped or [""]))
    return rows.groupBy("photo_id").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("class", "tag"))), lambda s: s["tag"])), 1, n).alias("tags"))

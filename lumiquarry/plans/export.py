"""Export plans, rating write-back, recaps and small state files."""

from __future__ import annotations

import html
import json
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiquarry.functions.scores import blend
from lumiquarry.functions.texts import clean_name, ranked_name
from lumiquarry.operators.rank import quota_then_best
from lumiquarry.sources.media import RAW

# Stars of a verdict.
STARS = {"liked": 5, "curated": 4, "rejected": 1}


def export_plan(items: DataFrame, *, by_day: bool = False, digits: int = 3) -> DataFrame:
    """(photo_id, path, target): where each file goes below the export's folder. ``items``: photo_id, path, day, rank."""
    name = ranked_name(F.col("rank"), F.regexp_extract("path", r"([^/]*)$", 1), digits)
    target = F.when(F.col("day").isNotNull(), F.concat(clean_name(F.col("day")), F.lit("/"), name)).otherwise(name) if by_day else name
    return items.select("photo_id", "path", target.alias("target"))


def copied(plan: Iterable, folder: str, archive: str | None = None) -> dict:
    """Copies the files of a plan's rows, or zips them; the driver does it, as people export some hundred files. A file that is missing is listed as skipped."""
    done, size, skipped = 0, 0, []
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    pack = zipfile.ZipFile(root / archive, "w", zipfile.ZIP_STORED) if archive else None
    for row in plan:
        source = Path(row["path"])
        if not source.is_file():
            skipped.append({"photo_id": row["photo_id"], "reason": "missing"})
            continue
        if pack:
            pack.write(source, row["target"])
        else:
            (root / row["target"]).parent.mkdir(parents=True, exist_ok=True)
            shutil.copy2(source, root / row["target"])
        done, size = done + 1, size + source.stat().st_size
    if pack:
        pack.close()
    return {"count": done, "bytes": size, "path": str(root / archive if archive else root), "skipped": skipped}


def verdicts(swipes: DataFrame, source: str, items: DataFrame | None = None) -> DataFrame:
    """The photos of a source: "curated" (kept or silver), "liked" (kept), or "story:<id>" of ``items``."""
    if source.startswith("story:"):
        return items.where(F.col("story_id").cast("string") == source.removeprefix("story:")).select("photo_id").distinct()
    kinds = {"curated": ["keep", "silver"], "liked": ["keep"]}[source]
    return swipes.where(F.col("decision").isin(kinds)).select("photo_id")


def rating_plan(photos: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """(photo_id, path, verdict, new_rating, target, is_sidecar, existing_rating, action, reason).

    ``photos``: photo_id, path, verdict, present (whether the file is there); ``existing``: target, existing_rating. Raw
    files are rated in a file beside them. A higher rating is left, an equal one too, unless ``force``.
    """
    stars = F.coalesce(*[F.when(F.col("verdict") == v, n) for v, n in STARS.items()])
    raw = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(list(RAW))
    known = stars.isNotNull()
    rows = photos.withColumns({"new_rating": F.coalesce(stars, F.lit(0)), "is_sidecar": F.coalesce(known & raw, F.lit(False)), "_raw": raw})
    rows = rows.withColumn("target", F.when(F.col("is_sidecar"), F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".xmp"))).otherwise(F.col("path")))
    rows = rows.join(existing, "target", "left").withColumn("existing_rating", F.when(F.col("new_rating") > 0, F.col("existing_rating")))
    reason = F.when(F.col("new_rating") == 0, F.concat(F.lit("unknown verdict "), F.col("verdict"))).when(~F.col("present") & F.col("_raw"), "source RAW missing").when(~F.col("present"), "source file missing")
    kept = F.lit(not force) & F.col("existing_rating").isNotNull()
    action = F.when(reason.isNotNull(), "no_op").when(kept & (F.col("existing_rating") > F.col("new_rating")), "skip_lower").when(kept & (F.col("existing_rating") == F.col("new_rating")), "skip_same").otherwise("write")
    return rows.select("photo_id", "path", "verdict", "new_rating", "target", "is_sidecar", "existing_rating", action.alias("action"), reason.alias("reason"))


def recap_images(items: DataFrame, captions: DataFrame, most: int = 40) -> DataFrame:
    """(day, place, photo_id, taken_at, caption, hashtags): the pictures of a recap in their order, with their day's caption.

    ``items``: day, photo_id, rank, taken_at, nima, ap25, iqa. Each day has max(1, most div days) of its best, the rest are the
    best of what is left, ``most`` in all while days are fewer. A picture's score is the blend of nima and ap25, or iqa, or
    1 less a hundredth of its rank. Within a day they go by time (nulls first). ``captions`` (day, caption, hashtags) is
    joined by day; a day without one has an empty caption. Items without a day are left out.
    """
    score = F.coalesce(blend(F.col("ap25"), F.col("nima")), F.col("iqa").cast("double"), F.greatest(F.lit(0.0), 1 - F.col("rank") * 0.01))
    rows = items.where(F.col("day").isNotNull()).select("day", "photo_id", "taken_at", score.alias("_score"))
    taken = quota_then_best(rows, "day", F.col("_score"), "photo_id", most)
    placed = taken.withColumn("place", F.row_number().over(Window.partitionBy("day").orderBy("taken_at", "photo_id")) - 1)  # most rows in all
    said = captions.groupBy("day").agg(F.first("caption").alias("caption"), F.first("hashtags").alias("hashtags"))
    return placed.join(said, "day", "left").select("day", "place", "photo_id", "taken_at", F.coalesce("caption", F.lit("")).alias("caption"), F.coalesce("hashtags", F.array().cast("array<string>")).alias("hashtags"))


def recap_html(title: str, period: str, facts: dict[str, object], days: Iterable[dict], route: str | None = None) -> str:
    """One page without outside references. A day is {title, subtitle, caption, images}, images are data URIs (40 in all at most are asked for by the caller's quota)."""
    esc = html.escape
    parts = [f"<!doctype html><meta charset='utf-8'><title>{esc(title)}</title><h1>{esc(title)}</h1><p>{esc(period)}</p>"]
    parts.append("<dl>" + "".join(f"<dt>{esc(k)}</dt><dd>{esc(str(v))}</dd>" for k, v in facts.items() if v is not None) + "</dl>")
    if route:
        parts.append(f"<svg viewBox='0 0 600 300'><polyline points='{esc(route)}' fill='none' stroke='currentColor'/></svg>")
    for d in days:
        if d["images"]:
            figures = "".join(f"<figure><img src='{esc(x)}' alt=''></figure>" for x in d["images"])
            parts.append(f"<section><h2>{esc(d['title'])}</h2><p>{esc(d.get('subtitle') or '')}</p><p>{esc(d.get('caption') or '')}</p>{figures}</section>")
    return "\n".join(parts)


def state_written(path: str, state: object) -> None:
    """A JSON file that is whole or not there: written beside its place and moved."""
    folder = os.path.dirname(path) or "."
    handle, name = tempfile.mkstemp(dir=folder, suffix=".tmp")
    with os.fdopen(handle, "w") as f:
        json.dump(state, f)
    os.replace(name, path)

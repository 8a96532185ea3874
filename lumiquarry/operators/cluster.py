"""Density, linkage and greedy algorithms. What is sequential by nature runs per bounded group in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiquarry.functions.geo import KM_PER_DEG_EQUATOR, KM_PER_DEG_LAT
from lumiquarry.operators.aggregate import mean_vectors
from lumiquarry.operators.graph import connected_components
from lumiquarry.operators.joins import hub_join
from lumiquarry.operators.pivots import near_rows
from lumiquarry.operators.scan import numbered
from lumiquarry.session import written

#: Groups of which it is open whether they are spread that go to every task; more are shuffled.
BROADCAST = 10_000


#: Parts of a cell an axis, and how often parts are cut again before points are held against points.
FINER, LEVELS = 8, 3


def dbscan(points: DataFrame, *, by: Sequence[str] = (), key: str = "photo_id", x: str = "lat", y: str = "lon", eps: float = 0.0025, least: int = 3) -> DataFrame:
    """C4: (key, cluster) of density clusters in the plane; noise is left out.

    A core point has ``least`` points within ``eps``, itself included; cores within ``eps`` of each other are one cluster,
    named by its least key; a border point goes to the least cluster that reaches it. Rows with a null or infinite coordinate
    or a null group take no part.

    Points are put in cells whose diagonal is ``eps``. All points of a cell that holds ``least`` of them are cores of one
    cluster, so no pairs are made within it: it is one node. Points of other cells, fewer than ``least`` a cell, are held
    against those of the cells around. Whether two full cells touch is decided on occupied parts of them, cut finer where
    that is open (``_touching``).
    """
    by = list(by)
    side = eps / math.sqrt(2) * (1 - 1e-9)
    real = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    kept = points.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], real(x) & real(y)))
    groups = [f"by{k}" for k in range(len(by))]
    cell = [*groups, "cx", "cy"]
    at = lambda c: F.floor(F.col(c) / side).cast("long")
    p = kept.select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumns({"cx": at("x"), "cy": at("y")})
    p = written(p, "points")
    cells = written(p.groupBy(*cell).agg(F.count("*").alias("n"), F.min("id").alias("node")).withColumn("cell", F.struct(*cell)), "cells")
    full = cells.where(F.col("n") >= least)
    placed = written(hub_join(p.withColumn("cell", F.struct(*cell)), cells.select("cell", "n", "node", F.col("n").alias("size")), "cell", "n", p.count()), "placed")
    # A cell is within reach of those two away, but not of the four corners.
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4])
    thin = placed.where(F.col("size") < least).select(*groups, F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", F.explode(around).alias("d"))
    thin = thin.select(*groups, "a", "ax", "ay", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    other = placed.select(*cell, F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by_"), F.when(F.col("size") >= least, F.col("node")).alias("full"))
    near = thin.join(other, cell).where(F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2)) + F.pow(F.col("ay") - F.col("by_"), F.lit(2))) <= eps)
    # Of a full cell it is enough that some point, and how many, are near.
    reach = written(near.groupBy("a", F.coalesce("full", "b").alias("b")).agg(F.count("*").alias("n"), F.max(F.col("full").isNotNull()).alias("full")), "reach")
    cores = reach.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("a")
    met = reach.join(cores.withColumnRenamed("a", "core"), F.col("b") == F.col("core"), "left").where(F.col("full") | F.col("core").isNotNull()).select("a", "b")
    links = met.join(cores, "a", "left_semi").union(_touching(placed.where(F.col("size") >= least), full, groups, side, eps))
    named = connected_components(links, "a", "b")
    cluster_of = full.select(F.col("node").alias("core")).union(cores.select(F.col("a").alias("core")))
    cluster_of = written(cluster_of.join(named, F.col("core") == F.col("node"), "left").select("core", F.coalesce("component", "core").alias("cluster")), "clusters")
    of_full = placed.where(F.col("size") >= least).select("id", "node", "size")
    sizes = full.select("node", "n").join(cluster_of, F.col("node") == F.col("core")).select("node", "n", "cluster")
    of_full = hub_join(of_full, sizes, "node", "n", p.count()).select("id", "cluster")
    of_core = cores.join(cluster_of, F.col("a") == F.col("core")).select(F.col("a").alias("id"), "cluster")
    border = met.join(cores, "a", "left_anti").join(cluster_of, F.col("b") == F.col("core")).groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
    return of_full.union(of_core).union(border).withColumnRenamed("id", key)


def _touching(points: DataFrame, full: DataFrame, groups: list[str], side: float, eps: float) -> DataFrame:
    """(a, b): nodes of full cells of which some points are within ``eps``.

    Cells are cut in FINER x FINER parts, and only what parts are occupied is known of them, so that a cell of any number of
    points has few. Two parts of which all points must be within ``eps`` decide that cells touch; parts of which none can be
    are done with; the points of the others are looked at again in finer parts, at last one by one, each place once.
    """
    ahead = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4 and (i, j) > (0, 0)])
    one = full.select(*groups, F.col("node").alias("a"), "cx", "cy", F.explode(ahead).alias("d")).select(*groups, "a", (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"))
    open_ = written(one.join(full.select(*groups, "cx", "cy", F.col("node").alias("b")), [*groups, "cx", "cy"]).select("a", "b"), "neighbours")
    done, before = None, []
    for level in range(1, LEVELS + 1):
        size = side / FINER**level
        part = [f"{c}{level}" for c in "xy"]
        places = [F.floor(F.col(c) / (side / FINER**k)).cast("long").alias(f"{c}{k}") for k in range(1, level + 1) for c in "xy"]
        occupied = written(points.select("node", *places).distinct(), "parts")
        sided = lambda s: occupied.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}{c}") for c in [*before, *part]])  # noqa: E731, B023
        pairs = open_.join(sided("a"), ["a", *[f"a{c}" for c in before]]).join(sided("b"), ["b", *[f"b{c}" for c in before]])
        gap = [F.abs(F.col(f"a{c}") - F.col(f"b{c}")) for c in part]
        least = F.hypot(*[F.greatest(F.lit(0), g - 1) * size for g in gap])
        most = F.hypot(*[(g + 1) * size for g in gap])
        seen = written(pairs.where(least <= eps * (1 + 1e-9)).withColumn("sure", most <= eps * (1 - 1e-9)), "touching")
        sure = seen.where("sure").select("a", "b").distinct()
        done = sure if done is None else done.union(sure)
        before = [*before, *part]
        open_ = seen.where(~F.col("sure")).join(sure, ["a", "b"], "left_anti").select("a", "b", *[f"{s}{c}" for s in "ab" for c in before])
        if open_.isEmpty():
            return done
    places = [F.floor(F.col(c) / (side / FINER**k)).cast("long").alias(f"{c}{k}") for k in range(1, LEVELS + 1) for c in "xy"]
    spots = written(points.select("node", *places, "x", "y").distinct(), "parts")
    sided = lambda s: spots.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}{c}") for c in [*before, "x", "y"]])
    pairs = open_.join(sided("a"), ["a", *[f"a{c}" for c in before]]).join(sided("b"), ["b", *[f"b{c}" for c in before]])
    apart = F.sqrt(F.pow(F.col("ax") - F.col("bx"), F.lit(2)) + F.pow(F.col("ay") - F.col("by"), F.lit(2)))
    return done.union(pairs.where(apart <= eps).select("a", "b").distinct())


def complete_linkage(vectors: np.ndarray, distance: float, *, held: int = 1 << 25) -> np.ndarray:
    """Labels, the least place in it, of the agglomeration of unit vectors while the farthest members of two clusters are ``distance`` (1 - cosine) apart at most.

    A chain of nearest neighbours: each cluster on it is followed by its nearest, and two that are nearest to each other
    merge, which never brings others nearer. A cluster whose nearest is too far is done. Time is quadratic, memory linear:
    of each cluster on the chain its least likeness to every row, ``held`` numbers in all; those given up are worked again.
    """
    n = len(vectors)
    label, members = np.arange(n), {k: np.array([k]) for k in range(n)}
    least = 1 - distance
    open_, chain, profile = set(range(n)), [], {}
    rest = iter(range(n))

    def likeness(c: int) -> np.ndarray:
        """The least cosine of any member of cluster ``c`` with each row."""
        if c not in profile:
            while profile and (len(profile) + 1) * n > held:
                profile.pop(next(iter(profile)))
            own, out = members[c], np.full(n, np.inf)
            for k in range(0, len(own), 64):
                np.minimum(out, (vectors @ vectors[own[k : k + 64]].T).min(axis=1), out=out)
            profile[c] = out
        return profile[c]

    while open_:
        if not chain:
            chain.append(next(k for k in rest if k in open_))
        tip = chain[-1]
        near = np.full(n, np.inf)
        np.minimum.at(near, label, likeness(tip))  # by cluster: of its least alike member
        near[tip] = -np.inf
        near[np.isinf(near)] = -np.inf
        best = int(np.argmax(near))
        if len(chain) > 1 and near[chain[-2]] == near[best]:
            best = chain[-2]
        if not near[best] >= least:
            chain.pop()
            open_.discard(tip)
        elif len(chain) > 1 and best == chain[-2]:
            both = np.minimum(likeness(tip), likeness(best))
            a, b = min(tip, best), max(tip, best)
            del chain[-2:]
            profile.pop(a, None), profile.pop(b, None)
            members[a] = np.concatenate([members[a], members.pop(b)])
            label[members[a]] = a
            open_.discard(b)
            profile[a] = both
            if not chain:
                chain.append(a)
        else:
            chain.append(best)
    return label


def persons(faces: DataFrame, *, key: str = "face_id", photo: str = "photo_id", vector: str = "embedding", distance: float = 0.55, merge: float = 0.65, least: int = 2) -> DataFrame:
    """(key, person): complete linkage of faces, then of the clusters' centroids, keeping persons on ``least`` photos; a person is named by its least key.

    Faces are linked from their pairs within ``distance``, the centroids of what comes of it from theirs within ``merge``.
    Pairs are found tile by tile (``pivots``), clusters merged in rounds (``linked``). Null and zero vectors take no part.
    """
    from lumiquarry.functions.vec import unit

    base = faces.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(photo).alias("photo"), unit(F.col(vector)).alias("v"))
    base = written(base.where(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) > 0.5), "faces")
    first = written(linked(base.select("id", "v"), distance), "linked")
    centres = mean_vectors(first.join(base.select("id", "v"), "id"), ["cluster"], "v").select(F.col("cluster").alias("id"), F.col("centroid").alias("v"))
    second = linked(written(centres, "centres"), merge).select(F.col("id").alias("cluster"), F.col("cluster").alias("merged"))
    of_face = first.join(second, "cluster").select("id", "merged").join(base.select("id", "photo"), "id")
    name = of_face.groupBy("merged").agg(F.min("id").alias("person"), F.count_distinct("photo").alias("n")).where(F.col("n") >= least)
    return of_face.join(name, "merged").select(F.col("id").alias(key), "person")


#: Edges between clusters that one task may hold.
LOCAL = 1 << 20


def merges_of(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pd.DataFrame:
    """(a, b): the merges that the rounds of ``linked`` make of the edges (a, b, s), a < b."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, n = code[: len(a)], code[len(a) :], len(nodes)
    made = []
    while len(a):
        order = np.lexsort((b, a, -s))
        a, b, s = a[order], b[order], s[order]
        place, best = np.arange(len(a)), np.full(n, len(a))
        np.minimum.at(best, a, place)
        np.minimum.at(best, b, place)
        pick = (best[a] == place) & (best[b] == place)
        made.append((a[pick], b[pick]))
        to, parts = np.arange(n), np.ones(n, np.int64)
        to[b[pick]], parts[a[pick]] = a[pick], 2
        a, b = np.minimum(to[a], to[b]), np.maximum(to[a], to[b])
        key = np.where(a < b, a * n + b, -1)
        order = np.argsort(key, kind="stable")
        order = order[np.searchsorted(key[order], 0) :]
        key, start, count = np.unique(key[order], return_index=True, return_counts=True)
        s = np.minimum.reduceat(s[order], start) if len(key) else s[:0]
        a, b = key // n, key % n
        whole = count == parts[a] * parts[b]
        a, b, s = a[whole], b[whole], s[whole]
    x, y = (np.concatenate(m) if made else np.zeros(0, np.int64) for m in (zip(*made, strict=True) if made else ((), ())))
    return pd.DataFrame({"a": nodes[x], "b": nodes[y]})


def linked(rows: DataFrame, distance: float) -> DataFrame:
    """(id, cluster): complete linkage of unit vectors (id, v) within ``distance``; a cluster is named by its least id.

    Two clusters may merge while all pairs between them are within ``distance``: clusters are nodes, an edge holds the least
    likeness of such a pair, and edges that miss a pair are dropped. In a round all clusters that are nearest to each other
    merge at once, which complete linkage lets them do in any order; no task holds a component. Ties go to the lesser ids.
    Equal vectors go as one. Once LOCAL edges are left, a number that does not grow with the rows, one task does the rest.
    """
    same = written(rows.groupBy("v").agg(F.min("id").alias("id"), F.collect_list("id").alias("ids")), "vectors")
    e = written(near_rows(same.select("id", "v"), 1 - distance).select("a", "b", F.col("similarity").alias("s")), "likenesses")
    merges = None
    while e.count() > LOCAL:
        ends = e.select("a", "b", "s", F.explode(F.array("a", "b")).alias("node"))
        best = ends.groupBy("node").agg(F.max(F.struct("s", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("e"))
        now = written(best.groupBy((-F.col("e.a")).alias("a"), (-F.col("e.b")).alias("b")).agg(F.count("*").alias("n")).where("n = 2").select("a", "b"), "merges")
        merges = now if merges is None else merges.union(now)
        to = now.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("to"))
        for end in ("a", "b"):
            e = e.join(to.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end, "left")
        a, b = F.coalesce("a_to", "a"), F.coalesce("b_to", "b")
        parts = F.when(F.col("a_to").isNull(), 1).otherwise(2) * F.when(F.col("b_to").isNull(), 1).otherwise(2)
        e = e.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), "s", parts.alias("parts")).where("a < b")
        e = written(e.groupBy("a", "b").agg(F.min("s").alias("s"), F.max("parts").alias("parts"), F.count("*").alias("n")).where("n = parts").select("a", "b", "s"), "likenesses")
    rest = e.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: merges_of(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["s"].to_numpy()), "a long, b long")
    names = connected_components(rest if merges is None else merges.union(rest), "a", "b")
    told = same.select("id", "ids").join(names.withColumnRenamed("node", "id"), "id", "left").select("ids", F.coalesce("component", "id").alias("cluster"))
    return told.select(F.explode("ids").alias("id"), "cluster")


# Picks by scene size, weights of quality, gain and likeness, the likeness that rules a photo out.
PICKS = ((60, 15), (30, 10), (15, 6), (8, 3))
IQA, SHARP, FACE, GAIN, LIKE, TOO_LIKE = 0.5, 0.3, 0.2, 0.45, 0.55, 0.88


def representatives(rows: DataFrame, by: Sequence[str], *, key: str = "photo_id", vector: str = "v") -> DataFrame:
    """(by, key, pick): photos of each scene that are good and unlike each other, best first.

    ``rows`` has iqa, blur, p95 (the story's 95th percentile of sharpness) and face (0 to 1) besides. A scene is one
    group: its size is what a camera takes in some minutes.
    """
    by = list(by)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        n = len(pdf)
        most = next((m for size, m in PICKS if n >= size), max(1, n // 3))
        p95 = pdf["p95"].fillna(1.0).to_numpy()
        q = IQA * pdf["iqa"].fillna(0).to_numpy() + SHARP * np.minimum(pdf["blur"].fillna(0).to_numpy() / np.where(p95 > 0, p95, 1.0), 1) + FACE * pdf["face"].fillna(0).to_numpy()
        v = np.stack(pdf[vector]).astype(float)
        chosen = [int(np.argmax(q))]
        likeness = v @ v[chosen[0]]
        while len(chosen) < most:
            value = np.where(likeness >= TOO_LIKE, -np.inf, GAIN * q - LIKE * likeness)
            value[chosen] = -np.inf
            at = int(np.argmax(value))
            if value[at] == -np.inf:
                break
            chosen.append(at)
            likeness = np.maximum(likeness, v @ v[at])
        return pdf.loc[chosen, [*by, key]].assign(pick=np.arange(len(chosen), dtype="int32"))

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*by, key])
    return rows.groupBy(*by).applyInPandas(pick, f"{kinds}, pick int")


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points (n, 2)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows: Iterable[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


def _flat_km(lat: np.ndarray, lon: np.ndarray, other_lat: np.ndarray, other_lon: np.ndarray) -> np.ndarray:
    return np.hypot((lat - other_lat) * KM_PER_DEG_LAT, (lon - other_lon) * KM_PER_DEG_EQUATOR * np.cos(np.radians((lat + other_lat) / 2)))


#: Degrees of longitude up to which ``equirect_km`` to a point is convex, so that its greatest values are at corners of a hull.
CONVEX = 55.0


def spread_beyond(rows: DataFrame, by: Sequence[str], km: float) -> DataFrame:
    """(by): the groups of which two rows (lat, lon) lie more than ``km`` apart by ``equirect_km``. Null places are near everything.

    Least and greatest coordinates decide most groups. Of the others only corners of the convex hull can be farthest apart:
    each task keeps the corners of what it holds of a group, before anything is shuffled.
    """
    by = list(by)
    placed = rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(*by, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    ends = placed.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("lat", "lon")])
    tall = (F.col("_hi_lat") - F.col("_lo_lat")) * KM_PER_DEG_LAT
    cosines = [F.cos(F.radians(F.col(c))) for c in ("_lo_lat", "_hi_lat")]
    wide = (F.col("_hi_lon") - F.col("_lo_lon")) * KM_PER_DEG_EQUATOR
    across = F.when((F.col("_lo_lat") < 0) & (F.col("_hi_lat") > 0), F.lit(1.0)).otherwise(F.greatest(*cosines))
    far = (tall > km * (1 + 1e-9)) | (wide * F.least(*cosines) > km * (1 + 1e-9))
    near = F.hypot(tall, wide * across) <= km * (1 - 1e-9)
    judged = written(ends.select(*by, far.alias("_far"), near.alias("_near"), ((F.col("_hi_lon") - F.col("_lo_lon")) < CONVEX).alias("_convex")), "spread")
    open_ = judged.where("not _far and not _near").select(*by, "_convex")
    sure = judged.where("_far").select(*by)
    if open_.isEmpty():
        return sure
    left = placed.join(F.broadcast(open_) if open_.count() <= BROADCAST else open_, by)
    schema = left.schema

    def corners(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["_convex"].iloc[0]:
            return pdf.drop_duplicates(["lat", "lon"])
        c = hull(pdf[["lat", "lon"]].to_numpy())
        out = pdf.head(len(c)).copy()
        out["lat"], out["lon"] = c[:, 0], c[:, 1]
        return out

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, own in pdf.groupby(by, sort=False):
                yield corners(own)[schema.names]

    def farther(pdf: pd.DataFrame) -> pd.DataFrame:
        c = corners(pdf)
        lat, lon = c["lat"].to_numpy(), c["lon"].to_numpy()
        hit = any((_flat_km(lat[k], lon[k], lat[k + 1 :], lon[k + 1 :]) > km).any() for k in range(len(lat)))
        return pdf[by].head(int(hit))

    return sure.union(left.mapInPandas(reduced, schema).groupBy(*by).applyInPandas(farther, sure.schema))


def _number(c: str, df: DataFrame) -> Column:
    """A time or number as a double that orders alike."""
    return F.col(c).cast("timestamp").cast("double") if df.schema[c].dataType.typeName().startswith(("timestamp", "date")) else F.col(c).cast("double")


def numbered_per_day(visits: DataFrame, *, by: Sequence[str] = ("day",), km: float = 2.0) -> DataFrame:
    """W14 within days: (visit_id, name): where two visits of one name and day lie over ``km`` apart, all of that name but the earliest get their number by arrival.

    A null place is near everything; rows without a name or day keep their name. Places by arrival are counted in segments
    where a name and day hold more than a task's share of the rows (``scan``).
    """
    keys = [*by, "name"]
    v = visits.select("visit_id", *keys, "lat", "lon", _number("arrived_at", visits).alias("_at"))
    apart = written(spread_beyond(v, keys, km), "apart").withColumn("_far", F.lit(True))
    rows = v.join(apart, keys, "left")
    alone = rows.where(F.col("_far").isNull()).select("visit_id", "name")
    told = numbered(rows.where("_far"), keys, "_at", "visit_id", ["visit_id"], lambda prev: prev("visit_id").isNotNull(), "_place")
    named = F.when(F.col("_place") > 0, F.concat("name", F.lit(" ("), (F.col("_place") + 1).cast("string"), F.lit(")"))).otherwise(F.col("name"))
    return alone.union(told.select("visit_id", named.alias("name")))


class Heads:
    """Places no two of which are within ``km``, in the order in which they came, by rows of latitude and columns as wide as ``km`` there."""

    def __init__(self, km: float):
        self.km, self.step, self.count = km, km / KM_PER_DEG_LAT, 0
        self.rows: dict[int, dict[int, list[tuple[int, float, float]]]] = {}

    def width(self, row: int) -> float:
        """Degrees of longitude that ``km`` is at most between a place in ``row`` and one in it or beside it."""
        edge = min(89.9999, (max(abs(row), abs(row + 1)) + 1) * self.step)
        return self.km / (KM_PER_DEG_EQUATOR * math.cos(math.radians(edge)))

    def of(self, lat: float | None, lon: float | None) -> int:
        """The number, from 0, of the first head within ``km``; the place is a new head where there is none. A missing place is near nothing."""
        if lat is not None and lon is not None:
            row, best = math.floor(lat / self.step), None
            for r in (row - 1, row, row + 1):
                if r in self.rows:
                    col = math.floor(lon / self.width(r))
                    for c in (col - 1, col, col + 1):
                        for k, y, x in self.rows[r].get(c, ()):
                            if (best is None or k < best) and math.hypot((lat - y) * KM_PER_DEG_LAT, (lon - x) * KM_PER_DEG_EQUATOR * math.cos(math.radians((lat + y) / 2))) <= self.km:
                                best = k
            if best is not None:
                return best
            self.rows.setdefault(row, {}).setdefault(math.floor(lon / self.width(row)), []).append((self.count, lat, lon))
        self.count += 1
        return self.count - 1


def numbered_places(visits: DataFrame, *, km: float = 2.0) -> DataFrame:
    """(visit_id, name): places of one name that lie apart get numbers by arrival, a place that is near an earlier one its number.

    Visits at one place share its number, so each place of a name goes once, at its first arrival, past the heads so far,
    which lie in a grid: a task holds the heads of one name. Numbers come back to the visits by ``hub_join``. A missing place
    is near nothing; visits without a name keep none.
    """
    spot = F.when(F.col("lat").isNull() | F.col("lon").isNull(), F.col("visit_id"))
    rows = visits.select("visit_id", F.regexp_replace("name", r"\s*\(\d+\)$", "").alias("base"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), _number("arrived_at", visits).alias("at"), spot.alias("spot"))
    rows = rows.withColumn("where", F.struct("base", "lat", "lon", "spot"))
    first = rows.groupBy("where").agg(F.min(F.struct(F.col("at").isNull().alias("late"), "at", "visit_id")).alias("came"), F.count("*").alias("n"))
    dealt = first.select("where", "n", "came", F.col("where.base").alias("base"), F.col("where.lat").alias("lat"), F.col("where.lon").alias("lon"))
    dealt = dealt.where(F.col("base").isNotNull()).repartition("base").sortWithinPartitions("base", "came")
    schema = dealt.select("where", "n", F.lit(0).cast("long").alias("place")).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, Heads(km)
        for batch in batches:
            place = []
            for base, lat, lon in zip(*(batch.column(c).to_pylist() for c in ("base", "lat", "lon")), strict=True):
                if base != now:
                    now, heads = base, Heads(km)
                place.append(heads.of(lat, lon))
            yield pa.RecordBatch.from_arrays([batch.column("where"), batch.column("n"), pa.array(place, pa.int64())], names=schema.names)

    placed = written(dealt.mapInArrow(number, schema), "places")
    rows = written(rows, "visits")
    named = hub_join(rows.where(F.col("base").isNotNull()), placed, "where", "n", rows.count())
    told = named.select("visit_id", F.when(F.col("place") > 0, F.concat("base", F.lit(" ("), (F.col("place") + 1).cast("string"), F.lit(")"))).otherwise(F.col("base")).alias("name"))
    return told.union(rows.where(F.col("base").isNull()).select("visit_id", F.col("base").alias("name")))


# The words that make a name a landmark's.
LANDMARK_WORDS = ("Monastery", "Stupa", "Tso", "Pass", "Dunes", "Valley")


def merged_names(places: DataFrame, *, km: float = 5.0, words: Sequence[str] = LANDMARK_WORDS) -> DataFrame:
    """(name, merged): the name that each place goes by. ``places``: name (once each), lat, lon, photos.

    Names within ``km`` contest pair by pair, in the order of names; a name that has lost contests no more. The one with
    a landmark word wins, then the one of more photos, of the longer name, the first. Pairs come from an equi-join on
    cells; only names that pairs connect meet in one task, as a later contest depends on earlier ones. A name without a
    place is its own.
    """
    strength = F.struct(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("name", w)).alias("mark"), F.coalesce(F.col("photos").cast("long"), F.lit(0)).alias("photos"), F.length("name").alias("size"))
    p = places.select("name", "lat", "lon", strength.alias("strength"))
    step = km / KM_PER_DEG_LAT
    # Degrees of longitude shorten towards the poles: the cells of a row are as wide as ``km`` is one row nearer the pole.
    row = F.floor(F.col("lat") / step).cast("long")
    wide = lambda r: step / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.0), (F.greatest(F.abs(r), F.abs(r + 1)) + 1) * step))))
    around = p.withColumn("_y", F.explode(F.array(row - 1, row, row + 1)))
    around = around.withColumn("_x", F.explode(F.array(*[F.floor(F.col("lon") / wide(F.col("_y"))).cast("long") + k for k in (-1, 0, 1)])))
    own = p.withColumn("_y", row).withColumn("_x", F.floor(F.col("lon") / wide(F.col("_y"))).cast("long"))
    b = own.select("_y", "_x", F.col("name").alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"), F.col("strength").alias("bs"))
    pairs = around.select("_y", "_x", F.col("name").alias("a"), "lat", "lon", F.col("strength").alias("as_")).join(b, ["_y", "_x"]).where(F.col("a") < F.col("b"))
    flat = KM_PER_DEG_LAT * F.hypot(F.col("lat") - F.col("blat"), (F.col("lon") - F.col("blon")) * F.cos(F.radians((F.col("lat") + F.col("blat")) / 2)))
    contests = pairs.where(flat <= km).select("a", "b", (F.col("as_") >= F.col("bs")).alias("first_wins"))
    contests = contests.join(connected_components(contests, "a", "b"), F.col("a") == F.col("node"))

    def contest(pdf: pd.DataFrame) -> pd.DataFrame:
        to: dict[str, str] = {}
        for a, b, first_wins in pdf.sort_values(["a", "b"])[["a", "b", "first_wins"]].itertuples(index=False):
            if a not in to and b not in to:
                winner, loser = (a, b) if first_wins else (b, a)
                to[loser] = winner
        return pd.DataFrame({"name": list(to), "merged": list(to.values())}, dtype="object")

    lost = contests.groupBy("component").applyInPandas(contest, "name string, merged string")
    return places.select("name").join(lost, "name", "left").select("name", F.coalesce("merged", "name").alias("merged"))

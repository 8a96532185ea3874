"""J12, J13 for C1: links between rows of near times that join the same rows as all their pairs do, without a row a pair."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiquarry.operators.graph import contracted, roots
from lumiquarry.operators.pivots import stacked
from lumiquarry.session import written

#: Widths that a slot of time is long, rows of a slot that one task takes, and rows that are held at once against how many.
SLOT, DENSE = 10, 1 << 16
BLOCK, AGAINST = 128, 1024


class Rows(NamedTuple):
    """Rows in order of group and time. ``faces`` are all rows' as one matrix, zeros behind shorter ones, ``wide`` their lengths and ``owned`` how many a row has."""

    group: np.ndarray
    id: np.ndarray
    at: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    placed: np.ndarray
    none: np.ndarray
    v: np.ndarray
    owned: np.ndarray
    faces: np.ndarray
    wide: np.ndarray

    def since(self, begin: int) -> Rows:
        first = self.owned[:begin].sum()
        return Rows(*(x[begin:] for x in self[:9]), self.faces[first:], self.wide[first:])

    def then(self, more: Rows) -> Rows:
        width = max(self.faces.shape[1], more.faces.shape[1])
        wider = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
        return Rows(*(np.concatenate([x, y]) for x, y in zip(self[:9], more[:9], strict=True)), np.concatenate([wider(self.faces), wider(more.faces)]), np.concatenate([self.wide, more.wide]))


def _read(batch: pa.RecordBatch) -> Rows:
    plain = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    v = stacked(batch.column("v")).astype(np.float64)
    with np.errstate(invalid="ignore"):
        v /= np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-6)
    faces = batch.column("faces")
    each = faces.flatten()
    wide = np.diff(each.offsets.to_numpy()) if len(each) else np.zeros(0, np.int64)
    flat = np.zeros((len(each), wide.max(initial=0)))
    flat[np.arange(flat.shape[1]) < wide[:, None]] = each.flatten().to_numpy(zero_copy_only=False)
    placed = batch.column("lat").is_valid().to_numpy(zero_copy_only=False) & batch.column("lon").is_valid().to_numpy(zero_copy_only=False)
    group = np.stack([plain(c) for c in ("slot", "i", "j")], axis=1)
    return Rows(group, plain("id"), plain("at"), plain("lat"), plain("lon"), placed, plain("none"), v, np.diff(faces.offsets.to_numpy()), flat, wide)


def _shared(r: Rows, first: np.ndarray, b: slice, a: slice, cosine: float) -> np.ndarray:
    """Of each row of ``b`` and of ``a``: both without faces, or two of theirs alike."""
    ok = r.none[b][:, None] & r.none[a]
    x, y = np.flatnonzero(r.owned[b]), np.flatnonzero(r.owned[a])
    if len(x) and len(y):
        p, q = slice(first[b.start], first[b.stop]), slice(first[a.start], first[a.stop])
        like = ~(r.faces[p] @ r.faces[q].T < cosine) & (r.wide[p][:, None] == r.wide[q])
        if (r.owned[a] > 1).any():
            like = np.logical_or.reduceat(like, first[a][y] - q.start, axis=1)
        if (r.owned[b] > 1).any():
            like = np.logical_or.reduceat(like, first[b][x] - p.start, axis=0)
        ok[np.ix_(x, y)] = like
    return ok


def _links(r: Rows, fresh: int, width: float, similar: float, degrees: float, cosine: float) -> tuple[list[np.ndarray], int]:
    """Places (u, v) of rows: a forest of the links of each BLOCK of rows from ``fresh`` on to the rows before; and where the last row's window begins."""
    n = len(r.at)
    head = np.flatnonzero(np.append(True, (r.group[1:] != r.group[:-1]).any(axis=1)))
    code = np.repeat(np.arange(len(head)), np.diff(np.append(head, n)))
    first = np.concatenate([[0], np.cumsum(r.owned)])
    begins = lambda k: head[code[k]] + int(np.searchsorted(width - (r.at[k] - r.at[head[code[k]] : k]) >= 0, True))
    out = []
    for start in range(fresh, n, BLOCK):
        b = slice(start, min(start + BLOCK, n))
        low, pairs = begins(start), []
        for at in range(low, b.stop, AGAINST):
            a = slice(at, min(at + AGAINST, b.stop))
            ok = (code[b][:, None] == code[a]) & (r.at[b][:, None] - r.at[a] <= width) & (np.arange(a.start, a.stop) < np.arange(b.start, b.stop)[:, None])
            if not ok.any():
                continue
            ok &= _shared(r, first, b, a, cosine)
            ok &= ~(r.v[b] @ r.v[a].T < similar)
            if r.placed[b].any() and r.placed[a].any():
                apart = np.sqrt((r.lat[b][:, None] - r.lat[a]) ** 2 + (r.lon[b][:, None] - r.lon[a]) ** 2)
                ok &= (apart <= degrees) | ~(r.placed[b][:, None] & r.placed[a])
            x, y = np.divmod(np.flatnonzero(ok), a.stop - a.start)
            pairs.append(np.stack([x + (b.start - low), y + (a.start - low)]))
        if pairs:
            u, v = np.concatenate(pairs, axis=1)
            up = roots(u, v, b.stop - low)
            rest = np.flatnonzero(up != np.arange(len(up)))
            out.append(np.stack([rest, up[rest]]) + low)
    return out, begins(n - 1)


def band_links(rows: DataFrame, *, at: str, key: str, width: float, similar: float, degrees: float, cosine: float = 0.55, dense: int = DENSE) -> DataFrame:
    """(a, b): links that join the same rows as all pairs within ``width`` of time that are near, alike and share a face.

    ``rows`` has lat, lon, v (scaled to unit length here, so that the stored numbers are what is shuffled) and faces (arrays
    of unit vectors); the tests are those of ``degrees_apart``, ``dot`` and ``shares_identity``. A row goes to its slot of time
    and, near its end, to the next. A task holds the rows of one window and gives a forest of their links. Where a slot has
    more than ``dense`` rows these are dealt to parts by hash, and any two parts meet in a task, so that memory is bounded
    whatever the times are. Rows without a time or vector, or with a null in it, link with none.
    """
    slot = lambda c: F.floor(c / (SLOT * width)).cast("long")
    time = F.col(at).cast("double")
    slots = F.explode(F.array_distinct(F.array(slot(time), slot(time + 1.01 * width)))).alias("slot")
    timed = rows.where(F.col(at).isNotNull() & ~F.isnan(time))
    crowded = written(timed.select(slots).groupBy("slot").agg(F.ceil(F.count("*") / dense).cast("int").alias("parts")).where("parts > 1"), "crowded")
    full = lambda x: x.isNotNull() & F.forall(x, lambda c: c.isNotNull())
    base = timed.where(full(F.col("v")) & F.col(key).isNotNull()).select(
        F.size("v").alias("dims"), slots, F.col(key).alias("id"), time.alias("at"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "v",
        (F.coalesce(F.size("faces"), F.lit(0)) <= 0).alias("none"), F.coalesce(F.filter("faces", full), F.array()).cast("array<array<double>>").alias("faces"),
    )
    if crowded.isEmpty():
        dealt = base.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        dealt = base.join(crowded, "slot", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        dealt = dealt.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))}).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "parts")
    order = ["dims", "slot", "i", "j"]
    dealt = dealt.repartition(*order).sortWithinPartitions(*order, "at")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column("dims").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1), len(dims)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                now, fresh = _read(batch.slice(begin, end - begin)), 0
                if before is not None and before.v.shape[1] == now.v.shape[1]:
                    now, fresh = before.then(now), len(before.at)
                pairs, keep = _links(now, fresh, width, similar, degrees, cosine)
                if pairs:
                    u, v = np.concatenate(pairs, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(now.id[u], batch.schema.field("id").type), pa.array(now.id[v], batch.schema.field("id").type)], names=["u", "v"])
                before = now.since(keep)

    kind = dealt.schema["id"].dataType.simpleString()
    links = dealt.mapInArrow(lambda batches: contracted(found(batches)), f"u {kind}, v {kind}")
    return links.select(F.col("u").alias("a"), F.col("v").alias("b"))

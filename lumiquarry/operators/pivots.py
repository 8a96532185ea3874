"""Exact joins of vectors by angle: rows are cut into tiles around pivots, and tiles that the triangle inequality keeps apart never meet.

The angle between vectors is a metric. A tile knows the least and greatest angle of its rows to every pivot; where for some
pivot those ranges of two tiles lie more than the wanted angle apart, no pair of their rows can be near.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiquarry.session import written

#: Rows that pivots are chosen from, pivots, and rows of a tile.
SAMPLE, PIVOTS, TILE = 2048, 64, 1024
#: Rows up to which all tiles meet.
SMALL = 4096
#: Blocks that all rows make up, rows of a block at most, and products that a task holds at once.
BLOCKS, WIDEST, HELD = 24, 32_768, 1 << 22
#: Room for rounding in an angle.
SLACK = 1e-6


def farthest_first(vectors: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of the vectors, each the farthest from those before it: with as many clusters or fewer, one of each."""
    if not len(vectors):
        return vectors
    chosen, near = [0], vectors @ vectors[0]
    while len(chosen) < most:
        at = int(np.argmin(near))
        if near[at] >= 1 - 1e-9:
            break
        chosen.append(at)
        near = np.maximum(near, vectors @ vectors[at])
    return vectors[chosen]


def angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1, 1))


def stacked(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, all of one length, as a matrix."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % len(column) or (np.diff(column.offsets.to_numpy()) != len(flat) // len(column)).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1)


def chosen_pivots(rows: DataFrame, vector: str, key: str) -> np.ndarray:
    """Pivots from the SAMPLE rows whose keys hash least. Any pivots are right; these are apart from one another."""
    sample = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(vector).toArrow()
    return farthest_first(stacked(sample.column(0).combine_chunks()), PIVOTS)


def tiled(rows: DataFrame, pivots: np.ndarray, *, by: Sequence[str], key: str, vector: str, size: int = TILE) -> DataFrame:
    """``rows`` with cell, the nearest pivot, and tile, a number: at most ``size`` rows of one group and cell at like angles to their pivot.

    Rows are range-partitioned by group, cell and angle, so that a cell that holds a third of all rows is cut in many
    tasks; a tile never reaches beyond its partition. The result is written, as tiles must be the same for all readers.
    """
    held = rows.sparkSession.sparkContext.broadcast(pivots)
    kind = rows.schema

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = angles(stacked(batch.column(vector)), held.value) if batch.num_rows else np.zeros((0, 1))
            cell = a.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(a[np.arange(len(a)), cell], pa.float64())], names=[*kind.names, "cell", "angle"])

    placed = rows.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("angle")).schema
    order = [*by, "cell", "angle", key]
    dealt = rows.mapInArrow(near, placed).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, tile = None, 0, -1
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for i, at in enumerate(zip(*(batch.column(c).to_pylist() for c in (*by, "cell")), strict=True)):
                if at != last or n == size:
                    last, n, tile = at, 0, tile + 1
                n += 1
                out[i] = tile
            out += batch.column("part").to_numpy().astype(np.int64) << 32
            yield pa.RecordBatch.from_arrays([*batch.select([*kind.names, "cell"]).columns, pa.array(out)], names=[*kind.names, "cell", "tile"])

    return written(dealt.mapInArrow(cut, rows.select("*", F.lit(0).alias("cell"), F.lit(0).cast("long").alias("tile")).schema), "tiles")


def bounds(tiles: DataFrame, pivots: np.ndarray, *, by: Sequence[str], vector: str) -> DataFrame:
    """(by, cell, tile, lo, hi): of each tile the least and greatest angles to all pivots. Ranges of batches are merged per tile."""
    held = tiles.sparkSession.sparkContext.broadcast(pivots)
    keys = [*by, "cell", "tile"]
    schema = tiles.select(*keys, F.array(F.lit(0.0)).alias("lo"), F.array(F.lit(0.0)).alias("hi")).schema

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, tile = angles(stacked(batch.column(vector)), held.value), batch.column("tile").to_numpy()
            order = np.argsort(tile, kind="stable")
            start = np.flatnonzero(np.append(True, np.diff(tile[order]) != 0))
            lo, hi = np.minimum.reduceat(a[order], start), np.maximum.reduceat(a[order], start)
            first = batch.select(keys).take(pa.array(order[start]))
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(list(lo), pa.list_(pa.float64())), pa.array(list(hi), pa.list_(pa.float64()))], names=schema.names)

    found = tiles.select(*keys, vector).mapInArrow(part, schema)
    both = lambda f, c: F.reduce(F.collect_list(c), F.first(c), lambda s, v: F.zip_with(s, v, f)).alias(c)  # noqa: E731  a tile has few
    return found.groupBy(*keys).agg(both(lambda x, y: F.least(x, y), "lo"), both(lambda x, y: F.greatest(x, y), "hi"))


def may_meet(a: str, b: str, angle: float) -> Column:
    """Whether the ranges of angles ``a_lo`` to ``a_hi`` and ``b_lo`` to ``b_hi`` come within ``angle`` for every pivot."""
    ranges = F.arrays_zip(*[F.col(f"{s}_{e}") for s in (a, b) for e in ("lo", "hi")])
    reach = angle + SLACK
    return F.forall(ranges, lambda r: (r[f"{a}_lo"] - r[f"{b}_hi"] <= reach) & (r[f"{b}_lo"] - r[f"{a}_hi"] <= reach))


def tile_pairs(ranges: DataFrame, angle: float, *, by: Sequence[str]) -> DataFrame:
    """(by, a, b), a <= b: pairs of tiles of a group whose rows could be within ``angle``.

    ``ranges`` is what ``bounds`` gives, written. Cells are held against cells first, PIVOTS squared a group at most; tiles
    meet cells, then the tiles of those cells, over equi-joins.
    """
    by = list(by)
    named = lambda df, s: df.select(*by, *[F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in by])
    each = ranges.select(*by, "cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("k", "r")).groupBy(*by, "cell", "k").agg(F.min("r.lo").alias("lo"), F.max("r.hi").alias("hi"))
    listed = F.array_sort(F.collect_list(F.struct("k", "lo", "hi")))
    ends = lambda c: F.transform(listed, lambda r: r[c]).alias(c)
    cells = each.groupBy(*by, "cell").agg(ends("lo"), ends("hi"))
    on = [*by] or F.lit(True)
    near = named(cells, "c").join(named(cells, "d"), on).where(may_meet("c", "d", angle)).select(*by, "c_cell", "d_cell", "d_lo", "d_hi")
    a, b = named(ranges, "a"), named(ranges, "b")
    reach = a.join(near.withColumnRenamed("c_cell", "a_cell"), [*by, "a_cell"]).where(may_meet("a", "d", angle))
    both = reach.join(b.withColumnRenamed("b_cell", "d_cell"), [*by, "d_cell"]).where((F.col("a_tile") <= F.col("b_tile")) & may_meet("a", "b", angle))
    return both.select(*by, F.col("a_tile").alias("a"), F.col("b_tile").alias("b"))


def blocks(tiles: DataFrame, *, by: Sequence[str] = (), size: int = TILE, parts: int | None = None, widest: int | None = None) -> DataFrame:
    """(by, tile, block): tiles in order, gathered to blocks that ``parts`` (BLOCKS) of hold all rows, of no more than ``widest`` (WIDEST) rows and a tile, and numbered within a group."""
    by = list(by)
    count = written(tiles.groupBy(*by, "tile").agg(F.count("*").alias("n")), "tilecounts")
    most = min(max(size, -(-(count.agg(F.sum("n")).first()[0] or 0) // (parts or BLOCKS))), max(size, widest or WIDEST))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("tile")) - F.col("n")
    return written(count.select(*by, "tile", F.floor(before / most).cast("long").alias("block")), "blocks")


def near_rows(rows: DataFrame, cosine: float, *, by: Sequence[str] = (), key: str = "id", vector: str = "v", look: str | None = None, alike: float = 0.93, size: int = TILE, small: int = SMALL) -> DataFrame:
    """(a, b, similarity), a < b, of unit vectors in one group ``by`` with a dot product of ``cosine`` or more.

    With ``look`` (unit vectors or null) that of the looks must be ``alike`` or more where both rows have one. Rows
    whose vector is zero, null or not finite have no direction and are in no pair, nor are rows of a null group. Tiles in
    order make up ``blocks``, and two blocks meet in one task, with those of their tiles that may meet one of the other: a
    row is copied once for each block that it may meet, so that what is shuffled grows with the rows and not with their
    square. Tables of up to ``small`` rows, a few tiles, are dealt to tiles by hash and all of these meet: pivots
    would take longer than they spare. Pairs are the same.
    """
    by = list(by)
    whole = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.col(vector).isNotNull() & ~F.isnan(whole) & (whole > 0.5)))
    base = lambda df, *more: df.select(*by, F.col(key).alias("id"), F.col(vector).alias("v"), (F.col(look) if look else F.lit(None).cast("array<double>")).alias("look"), *more)
    n = rows.limit(small + 1).count()
    if n <= small:
        parts = max(1, -(-n // size))
        tile, other = F.pmod(F.xxhash64(key), F.lit(parts)), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        dealt = base(rows, tile.cast("long").alias("tile"), other.alias("other")).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).withColumn("home", F.col("tile") == F.col("i"))
    else:
        pivots = chosen_pivots(rows, vector, key)
        tiles = base(tiled(rows, pivots, by=by, key=key, vector=vector, size=size), "cell", "tile")
        angle = float(np.arccos(np.clip(cosine, -1, 1)))
        pairs = tile_pairs(written(bounds(tiles, pivots, by=by, vector="v"), "bounds"), angle, by=by).select("a", "b")
        block = blocks(tiles, by=by, size=size)
        of = lambda s: block.select(F.col("tile").alias(s), F.col("block").alias(f"{s}_block"))
        met = pairs.join(of("a"), "a").join(of("b"), "b")
        i, j = F.least("a_block", "b_block").alias("i"), F.greatest("a_block", "b_block").alias("j")
        ends = [met.select(F.col(s).alias("tile"), i, j, (F.col(f"{s}_block") == F.least("a_block", "b_block")).alias("home")) for s in "ab"]
        dealt = tiles.join(written(ends[0].union(ends[1]).distinct(), "tilepairs"), "tile")
    order = [*by, "i", "j"]
    dealt = dealt.select(*order, "home", "id", "v", "look").repartition(*order).sortWithinPartitions(*order, F.desc("home"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, parts = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, v, look_ = batch.column("id").to_numpy(), stacked(batch.column("v")), _looks(batch.column("look"))
            at = list(zip(*(batch.column(c).to_pylist() for c in order), strict=True))
            home = batch.column("home").to_numpy(zero_copy_only=False)
            begin = 0
            for end in range(1, len(at) + 1):
                if end < len(at) and at[end] == at[begin] and home[end] == home[begin]:
                    continue
                if at[begin] != now:
                    if now and now[-1] == now[-2]:
                        yield from _hits(own or _joined(parts), None, cosine, alike)
                    now, own, parts = at[begin], None, []
                cut = (ids[begin:end], v[begin:end], look_[0][begin:end], look_[1][begin:end])
                if home[begin]:
                    parts.append(cut)
                elif parts or own:
                    own = own or _joined(parts)
                    yield from _hits(cut, own, cosine, alike)
                begin = end
        if now and now[-1] == now[-2]:
            yield from _hits(own or _joined(parts), None, cosine, alike)

    return dealt.mapInArrow(compare, "a long, b long, similarity double")


Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _looks(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The looks as a matrix, zeros where there is none, and which rows have one."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    own = stacked(column.drop_null())
    out = np.zeros((len(column), own.shape[1]))
    out[there] = own
    return out, there


def _joined(parts: list[Rows]) -> Rows:
    ids, v, look, there = zip(*parts, strict=True)
    wide = max(x.shape[1] for x in look)
    return np.concatenate(ids), np.concatenate(v), np.concatenate([x if x.shape[1] == wide else np.zeros((len(x), wide)) for x in look]), np.concatenate(there)


def _hits(one: Rows, other: Rows | None, cosine: float, alike: float) -> Iterator[pa.RecordBatch]:
    """The pairs of rows of ``one`` and ``other``, or within ``one``, some rows at a time."""
    begin, n = 0, len(one[0])
    while begin < n:
        ids, v, look, there = (x[begin:] for x in one) if other is None else other
        step = max(1, HELD // max(1, len(ids)))
        a_ids, a_v, a_look, a_there = (x[begin : begin + step] for x in one)
        near = a_v @ v.T
        ok = near >= cosine
        if other is None:
            ok[:, : len(a_ids)] = np.triu(ok[:, : len(a_ids)], 1)
        x, y = np.divmod(np.flatnonzero(ok), len(ids))
        both = a_there[x] & there[y]
        if both.any():
            keep = ~both
            keep[both] = np.einsum("ij,ij->i", a_look[x[both]], look[y[both]]) >= alike
            x, y = x[keep], y[keep]
        p, q = a_ids[x], ids[y]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q), pa.int64()), pa.array(np.maximum(p, q), pa.int64()), pa.array(near[x, y])], names=["a", "b", "similarity"])
        begin += step

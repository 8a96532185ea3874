"""Density clusters of unit vectors from the spanning tree of mutual reachability, in blocks of any size.

No task holds a block's distances. Exact nearest neighbours come from tiles of rows (``pivots``): a task holds some tiles and
streams the tiles that can matter past them, nearest first. The neighbours' edges are reduced to a spanning forest, and
Boruvka rounds, in which each tree takes its shortest way out over the same tiles, make it one tree. What one task holds of
a block is that tree: two keys and a length a row, no vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiquarry.operators.aggregate import mean_vectors
from lumiquarry.operators.graph import roots
from lumiquarry.operators.pivots import SLACK, TILE, blocks, bounds, chosen_pivots, stacked, tiled
from lumiquarry.session import written

#: Neighbours a row has in the first graph, at least; blocks of up to DENSE rows are worked whole, in one task each.
NEIGHBOURS, DENSE = 10, 1024
#: Blocks that all rows make up when they look for neighbours, and rows of a block at most.
PARTS, WIDEST = 16, 65_536
#: Edges that a task gathers before it leaves out those of no forest.
THINNED = 1 << 18
#: No row's key.
NOBODY = np.iinfo(np.int64).min


def spanning_forest(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of the least spanning forest of nodes 0 to n - 1, by place, and each node's tree: the least node in it. Boruvka rounds in arrays."""
    rank = np.empty(len(w), np.int64)
    rank[np.lexsort((np.maximum(u, v), np.minimum(u, v), w))] = np.arange(len(w))
    place = np.argsort(rank)
    tree, taken = np.arange(n), []
    while True:
        a, b = tree[u], tree[v]
        live = np.flatnonzero(a != b)
        if not len(live):
            return (np.concatenate(taken) if taken else np.zeros(0, np.int64)), tree
        best = np.full(n, len(w))
        np.minimum.at(best, a[live], rank[live])
        np.minimum.at(best, b[live], rank[live])
        chosen = place[np.unique(best[best < len(w)])]
        taken.append(chosen)
        tree = roots(a[chosen], b[chosen], n)[tree]


def tree_labels(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int, least: int) -> np.ndarray:
    """Labels (-1 noise) of nodes 0 to n - 1 from the edges of their spanning tree, cut where stability over its splits is greatest.

    Edges in order of length merge clusters of ``least`` or more nodes; a cluster lives from the inverse length at which it
    splits off to that at which it splits, and is kept if it outweighs what it splits into. The root is kept only where it
    does not split. Edges of one length (to 1e-12) merge at once, so labels do not depend on which spanning tree it is.
    """
    kids: list[list[int]] = [[] for _ in range(n)]  # of each cluster, those that merge into it; it comes after them
    level, size = [0.0] * n, [1] * n
    up, node = list(range(n)), list(range(n))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    w = np.round(w, 12)
    order = np.argsort(w, kind="stable")
    ends = np.flatnonzero(np.append(np.diff(w[order]) > 0, True)) + 1
    for first, last in zip([0, *ends[:-1]], ends, strict=True):
        merging: dict[int, list[int]] = {}
        for k in order[first:last]:
            a, b = find(int(u[k])), find(int(v[k]))
            x, y = merging.pop(a, None) or [node[a]], merging.pop(b, None) or [node[b]]
            if len(x) < len(y):
                a, b, x, y = b, a, y, x
            x.extend(y)
            up[b], merging[a] = a, x
        for a, parts in merging.items():
            node[a] = len(kids)
            kids.append(parts)
            level.append(1 / max(float(w[order[first]]), 1e-9))
            size.append(sum(size[x] for x in parts))

    def walked(top: int, born: float) -> tuple[float, list[int], float]:
        """The stability of the cluster ``top``, the clusters it splits into, and when."""
        score, now = 0.0, top
        while now >= n:
            big = [x for x in kids[now] if size[x] >= least]
            if len(big) > 1:
                return score + size[now] * (level[now] - born), big, level[now]
            score += (size[now] - sum(size[x] for x in big)) * (level[now] - born)
            if not big:
                break
            now = big[0]
        return score, [], 0.0

    root = len(kids) - 1
    big = [x for x in kids[root] if size[x] >= least]
    clusters = [(x, level[root], -1) for x in big] if len(big) > 1 else [(root, 0.0, -1)]
    scores = []
    for place, (top, born, _) in enumerate(clusters):  # grows while it is read: parts come after what they are part of
        score, parts, at = walked(top, born)
        scores.append(score)
        clusters += [(x, at, place) for x in parts]
    below, kept = [0.0] * len(clusters), [True] * len(clusters)
    for place in range(len(clusters) - 1, -1, -1):
        parent = clusters[place][2]
        kept[place] = scores[place] >= below[place]
        if parent >= 0:
            below[parent] += max(scores[place], below[place])
    mark, covered = [-1] * len(kids), [False] * len(clusters)
    for place, (top, _, parent) in enumerate(clusters):
        covered[place] = parent >= 0 and (covered[parent] or kept[parent])
        if kept[place] and not covered[place]:
            mark[top] = place
    for name in range(root, n - 1, -1):
        if mark[name] >= 0:
            for x in kids[name]:
                mark[x] = mark[name]
    return np.array(mark[:n])


def density_tree(vectors: np.ndarray, least: int) -> np.ndarray:
    """Labels (-1 noise) of the rows of one matrix; fewer than twice ``least`` rows are one cluster. All distances at once: for small blocks."""
    n = len(vectors)
    if n < 2 * least:
        return np.zeros(n, int)
    d = np.sqrt(np.maximum(2 - 2 * (vectors @ vectors.T), 0))
    core = np.sort(d, axis=1)[:, min(least, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    inside, best, frm = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        closer = (reach[at] < best) & ~inside
        best[closer], frm[closer] = reach[at][closer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[at], frm[at], at))
    w, u, v = (np.array(x) for x in zip(*edges, strict=True))
    return tree_labels(u, v, w, n, least)


def met(home: DataFrame, other: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(id, near, reach): for each row of ``home`` the ids of the up to ``k`` rows of ``other`` in another tree at the least mutual reach, least first.

    Both have tile, id, v (unit), tree, core and cap; reach is the greater of the distance and both cores, and less than the
    cap of ``home``. ``pairs`` says which tiles of ``other`` (b) a tile of ``home`` (a) needs, and the least distance (low)
    they can have. Tiles of ``home`` make up PARTS ``blocks`` (of WIDEST rows at most), and a row of ``other`` goes once to
    each block that needs it: what is shuffled grows with the rows and not with their square. A task holds a block, takes the
    other tiles nearest first, each after the list of the tiles that need it, and multiplies none that is farther than all
    such a tile has found.
    """
    block = blocks(home.select("tile"), parts=PARTS, widest=WIDEST)
    block = block.select("tile", F.col("block").cast("int").alias("block"))
    parts = (block.agg(F.max("block")).first()[0] or 0) + 1
    first = F.min("low").over(Window.partitionBy("block", "b"))
    heads = written(pairs.select("a", "b", "low").join(block.withColumnRenamed("tile", "a"), "a").select("block", "a", "b", "low").withColumn("first", first), "heads")
    none = lambda *names: [F.lit(None).cast(home.schema[c].dataType).alias(c) for c in names]
    no_head = [F.lit(None).cast(home.schema["tile"].dataType).alias("a"), F.lit(None).cast("double").alias("least")]
    columns = ["id", "v", "tree", "core", "cap"]
    own = home.select("tile", *columns).join(block, "tile").select("block", F.lit(0).alias("far"), F.lit(0.0).alias("low"), "tile", F.lit(False).alias("row"), *no_head, *columns)
    lists = heads.select("block", F.lit(1).alias("far"), F.col("first").alias("low"), F.col("b").alias("tile"), F.lit(False).alias("row"), "a", F.col("low").alias("least"), *none(*columns))
    wanted = heads.select("block", F.col("b").alias("tile"), F.col("first").alias("low")).distinct()
    rest = other.select("tile", *columns).join(wanted, "tile").select("block", F.lit(1).alias("far"), "low", "tile", F.lit(True).alias("row"), *no_head, *columns)
    order = ["block", "far", "low", "tile", "row"]
    dealt = own.union(lists).union(rest).repartitionById(parts, "block").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tiles, want, last = None, {}, {}, [], None

        def found() -> Iterator[pa.RecordBatch]:
            settle()
            for t in tiles.values():
                keep = t.near != NOBODY
                offsets = pa.array(np.concatenate([[0], np.cumsum(keep.sum(axis=1))]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(t.ids), pa.ListArray.from_arrays(offsets, pa.array(t.near[keep])), pa.ListArray.from_arrays(offsets, pa.array(t.best[keep]))], names=["id", "near", "reach"])

        def settle() -> None:
            for name, parts in held.items():
                tiles[name] = Home(k, *(np.concatenate(x) for x in zip(*parts, strict=True)))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            at = list(zip(*(batch.column(c).to_pylist() for c in order), strict=True))
            begin = 0
            for end in range(1, len(at) + 1):
                if end < len(at) and end - begin < TILE and at[end] == at[begin]:
                    continue
                block_, far, _, tile, row = at[begin]
                cut = batch.slice(begin, end - begin)
                if block_ != now:
                    if now is not None:
                        yield from found()
                    now, tiles = block_, {}
                if not far:
                    held.setdefault(tile, []).append((cut.column("id").to_numpy(), stacked(cut.column("v")), *(cut.column(c).to_numpy() for c in ("tree", "core", "cap"))))
                elif not row:
                    settle()
                    want = (want if last == at[begin] else []) + list(zip(cut.column("a").to_pylist(), cut.column("least").to_pylist(), strict=True))
                    last = at[begin]
                else:
                    rows = None
                    for a, least in want:
                        if least <= tiles[a].best[:, -1].max() + SLACK:
                            rows = rows or (cut.column("id").to_numpy(), stacked(cut.column("v")), cut.column("tree").to_numpy(), cut.column("core").to_numpy())
                            tiles[a].take(*rows)
                begin = end
        if now is not None:
            yield from found()

    return dealt.mapInArrow(run, "id long, near array<long>, reach array<double>")


class Home:
    """The rows of a tile and the ``k`` nearest of other trees found for each so far, nearest first."""

    def __init__(self, k: int, ids: np.ndarray, v: np.ndarray, tree: np.ndarray, core: np.ndarray, cap: np.ndarray) -> None:
        self.ids, self.v, self.tree, self.core = ids, v, tree, core
        self.best, self.near = np.repeat(cap[:, None], k, axis=1), np.full((len(ids), k), NOBODY)

    def take(self, ids: np.ndarray, v: np.ndarray, tree: np.ndarray, core: np.ndarray) -> None:
        """Holds other rows against the tile's; only rows that one of them is nearer to are sorted again."""
        reach = self.v @ v.T
        reach *= -2
        reach += 2
        np.maximum(reach, 0, out=reach)
        np.sqrt(reach, out=reach)
        np.maximum(reach, self.core[:, None], out=reach)
        np.maximum(reach, core, out=reach)
        nearer = reach < self.best[:, -1:]
        if np.isin(tree, self.tree).any():
            nearer &= self.tree[:, None] != tree
        x = np.flatnonzero(nearer.any(axis=1))
        if not len(x):
            return
        reach, k = np.where(nearer[x], reach[x], np.inf), self.best.shape[1]
        if reach.shape[1] > k:
            at = np.argpartition(reach, k - 1, axis=1)[:, :k]
            reach, who = np.take_along_axis(reach, at, 1), ids[at]
        else:
            who = np.broadcast_to(ids, reach.shape)
        best, near = np.hstack([self.best[x], reach]), np.hstack([self.near[x], np.where(np.isfinite(reach), who, NOBODY)])
        order = np.argsort(best, axis=1, kind="stable")[:, :k]
        self.best[x], self.near[x] = np.take_along_axis(best, order, 1), np.take_along_axis(near, order, 1)


def tile_ranges(ranges: DataFrame, by: str) -> DataFrame:
    """(a, b, low, high) of all pairs of tiles of a block: no rows of theirs are nearer than ``low`` or farther than ``high``, by every pivot."""
    side = lambda s: ranges.select(by, *[F.col(c).alias(f"{s}_{c}") for c in ("tile", "lo", "hi")])
    both = side("a").join(side("b"), by)
    zipped = F.arrays_zip("a_lo", "a_hi", "b_lo", "b_hi")
    low = F.aggregate(zipped, F.lit(0.0), lambda s, r: F.greatest(s, r["a_lo"] - r["b_hi"], r["b_lo"] - r["a_hi"]))
    high = F.aggregate(zipped, F.lit(math.pi), lambda s, r: F.least(s, r["a_hi"] + r["b_hi"]))
    chord = lambda angle: 2 * F.sin(angle / 2)
    return both.select(F.col("a_tile").alias("a"), F.col("b_tile").alias("b"), chord(low).alias("low"), chord(high).alias("high"))


def sure_edges(u: np.ndarray, v: np.ndarray, w: np.ndarray, sure: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which edges are of the spanning tree for certain, each node's tree by them, and by tree the place of its shortest other edge out (-1: none).

    ``sure`` marks those known before. An edge that leaves a tree is its shortest way out among all pairs of rows, not only
    these edges, if it is no longer than the ``radius`` of any node of the tree, within which a node has an edge to all others.
    """
    n = len(radius)
    first, tree = spanning_forest(u[sure], v[sure], w[sure], n)
    taken = [np.flatnonzero(sure)[first]]
    order = np.lexsort((np.maximum(u, v), np.minimum(u, v), w))
    rank = np.empty(len(w), np.int64)
    rank[order] = np.arange(len(w))
    while True:
        a, b = tree[u], tree[v]
        live = np.flatnonzero(a != b)
        best, reach = np.full(n, len(w)), np.full(n, np.inf)
        np.minimum.at(best, a[live], rank[live])
        np.minimum.at(best, b[live], rank[live])
        np.minimum.at(reach, tree, radius)
        out = np.where(best < len(w), np.append(order, -1)[np.minimum(best, len(w))], -1)
        right = np.flatnonzero((out >= 0) & (np.append(w, np.inf)[out] <= reach))
        if not len(right):
            return np.concatenate(taken), tree, out
        chosen = np.unique(out[right])
        taken.append(chosen)
        tree = roots(a[chosen], b[chosen], n)[tree]


def spanning_trees(rows: DataFrame, by: str, *, key: str, vector: str, least: int, size: int = TILE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(by, u, v, w): the edges of the spanning tree of mutual reachability of each block of unit vectors; ``by`` is not null.

    A row's core is its distance to its ``least``-th neighbour, or to the last. Every row must have a neighbour. Edges to the
    nearest neighbours are taken where they are sure to be a tree's shortest way out; where they are not, rounds look for
    shorter ones among the rows whose neighbours do not reach as far.
    """
    k = max(least, neighbours)
    base = rows.select(by, F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    pivots = chosen_pivots(base, "v", "id")
    tiles = tiled(base, pivots, by=[by], key="id", vector="v", size=size)
    ranges = written(bounds(tiles, pivots, by=[by], vector="v"), "bounds")
    pairs = written(tile_ranges(ranges, by), "tilepairs")
    count = tiles.groupBy("tile").agg(F.count("*").alias("n"))
    # Of rows enough to hold k neighbours and the row itself, none is farther than the greatest distance of their tiles.
    held = F.sum("n").over(Window.partitionBy("a").orderBy("high", "b"))
    known = pairs.join(count, pairs["b"] == count["tile"]).withColumn("held", held)
    enough = F.coalesce(F.min(F.when(F.col("held") > k, F.col("high"))).over(Window.partitionBy("a")), F.lit(2.0))
    wanted = known.withColumn("enough", enough).where(F.col("low") <= F.col("enough") + SLACK).select("a", "b", "low")
    no_cap = F.lit(float("inf"))
    plain = tiles.select("tile", "id", "v", F.col("id").alias("tree"), F.lit(0.0).alias("core"), no_cap.alias("cap"))
    near = written(met(plain, plain, wanted, k), "neighbours")
    core = F.coalesce(F.get("reach", F.lit(least - 1)), F.element_at("reach", -1))
    radius = F.when(F.size("reach") < k, no_cap).otherwise(F.element_at("reach", -1))
    points = written(tiles.join(near.select("id", core.alias("core"), radius.alias("radius")), "id"), "cores")
    edges = near.select("id", F.explode(F.arrays_zip("near", "reach")).alias("e")).select(F.col("id").alias("u"), F.col("e.near").alias("v"), F.col("e.reach").alias("d"))
    ends = lambda s: points.select(*([by] if s == "u" else []), F.col("id").alias(s), F.col("core").alias(f"{s}_core"))
    edges = edges.join(ends("u"), "u").join(ends("v"), "v").select(by, "u", "v", F.greatest("d", "u_core", "v_core").alias("w"))

    def thinned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The forest of a task's edges: no other edge is the shortest of these out of any set of nodes. A node is of one block."""
        held: list[pd.DataFrame] = []

        def forest() -> pd.DataFrame:
            pdf = pd.concat(held)
            nodes, code = np.unique(np.concatenate([pdf["u"], pdf["v"]]), return_inverse=True)
            return pdf.iloc[spanning_forest(code[: len(pdf)], code[len(pdf) :], pdf["w"].to_numpy(), len(nodes))[0]]

        for pdf in frames:
            held.append(pdf)
            if sum(map(len, held)) > THINNED:
                held = [forest()]
        if held:
            yield forest()

    maybe = written(edges.mapInPandas(thinned, edges.schema), "edges")
    schema = f"{by} {maybe.schema[by].dataType.simpleString()}, kind string, tree long, u long, v long, w double"
    rows_of = lambda df, kind, u="u", v="v", w="w": df.select(by, F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("tree"), F.col(u).alias("u"), F.col(v).alias("v"), F.col(w).alias("w"))

    def settled(pdf: pd.DataFrame) -> pd.DataFrame:
        """The block's sure edges; of each node its tree; of each tree its shortest known way out."""
        name, of_node = pdf[by].iloc[0], pdf[pdf["kind"] == "node"].sort_values("u")
        nodes, at = of_node["u"].to_numpy(), pdf[pdf["kind"] != "node"]
        u, v, w = np.searchsorted(nodes, at["u"].to_numpy()), np.searchsorted(nodes, at["v"].to_numpy()), at["w"].to_numpy()
        taken, tree, out = sure_edges(u, v, w, (at["kind"] == "sure").to_numpy(), of_node["w"].to_numpy())
        ways = np.flatnonzero(out >= 0)
        ways = ways[tree[ways] == ways]
        made = lambda kind, e, tree=None: pd.DataFrame({by: name, "kind": kind, "tree": tree, "u": nodes[u[e]], "v": nodes[v[e]], "w": w[e]})
        parts = [made("sure", taken), pd.DataFrame({by: name, "kind": "node", "tree": nodes[tree], "u": nodes, "v": nodes, "w": 0.0}), made("way", out[ways], nodes[ways])]
        return pd.concat([p for p in parts if len(p)])

    fixed = rows_of(maybe, "maybe").union(rows_of(points, "node", "id", "id", "radius"))
    sure = None
    while True:
        state = written((fixed if sure is None else fixed.union(rows_of(sure, "sure"))).groupBy(by).applyInPandas(settled, schema), "forest")
        trees = state.where("kind = 'node'").select(F.col("u").alias("id"), "tree", by)
        sure = state.where("kind = 'sure'").select(by, "u", "v", "w")
        if trees.groupBy(by).agg((F.min("tree") < F.max("tree")).alias("apart")).where("apart").isEmpty():
            return sure
        ways = state.where("kind = 'way'").select("tree", "u", "v", "w")
        capped = trees.join(ways.select("tree", F.col("w").alias("cap")), "tree", "left").select("id", "tree", F.coalesce("cap", no_cap).alias("cap"))
        now = written(points.join(capped, "id").select(by, "tile", "id", "v", "tree", "core", "cap", "radius"), "trees")
        home = now.where(F.col("radius") < F.col("cap"))
        found = met(home, now, _ways_out(home, now, pairs), 1).where(F.size("near") > 0).select("id", F.col("near")[0].alias("v"), F.col("reach")[0].alias("w"))
        found = now.select("id", "tree").join(found, "id").select("tree", F.col("id").alias("u"), "v", "w")
        best = found.unionByName(ways).groupBy("tree").agg(F.min(F.struct("w", "u", "v")).alias("e"))
        blocks = trees.select(F.col("id").alias("tree"), by)
        sure = sure.unionByName(best.join(blocks, "tree").select(by, F.col("e.u").alias("u"), F.col("e.v").alias("v"), F.col("e.w").alias("w")))


def _ways_out(home: DataFrame, rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of tiles that can hold a tree's shortest way out: not of one tree, and no farther than what is known, or than a way that is sure to be there."""
    facts = lambda df, s, *more: df.groupBy(F.col("tile").alias(s)).agg(F.min("tree").alias(f"{s}_lo"), F.max("tree").alias(f"{s}_hi"), F.max("core").alias(f"{s}_core"), *more)
    both = pairs.join(facts(home, "a", F.max("cap").alias("cap")), "a").join(facts(rows, "b"), "b")
    mixed: Column = F.col("b_lo") < F.col("b_hi")
    sure = mixed | ((F.col("a_lo") == F.col("a_hi")) & (F.col("a_lo") != F.col("b_lo")))  # every row of a has one of another tree in b
    bound = F.min(F.when(sure, F.greatest("high", "a_core", "b_core"))).over(Window.partitionBy("a"))
    one = (F.col("a_lo") == F.col("a_hi")) & (F.col("b_lo") == F.col("b_hi")) & (F.col("a_lo") == F.col("b_lo"))
    return both.withColumn("bound", F.least("cap", F.coalesce(bound, F.lit(2.0)))).where(~one & (F.col("low") <= F.col("bound") + SLACK)).select("a", "b", "low")


def density_clusters(rows: DataFrame, by: str | None = None, *, key: str = "photo_id", vector: str = "v", least: int = 5, dense: int = DENSE, size: int = TILE, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(by, key, cluster) of unit vectors per block, or of all rows as one; a cluster is named by its least key that is no outlier.

    Clusters are those of ``tree_labels``; outliers go to the cluster of the nearest centroid; a block of fewer than twice
    ``least`` rows, or without a cluster, is one cluster. ``least=5`` within session blocks gives the tight groups, 20 over
    all rows the look-back. Keys must be unique; null vectors and rows of no block take no part. Blocks of up to ``dense``
    rows are each worked in one task with all their distances, larger ones by ``spanning_trees``: both give the same.
    """
    named = by or "block"
    block = F.col(by) if by else F.lit(0)
    base = rows.where(F.col(vector).isNotNull() & block.isNotNull()).select(block.alias("block"), F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    counts = base.groupBy("block").agg(F.count("*").alias("n"))
    base = written(base.join(counts, "block"), "blocks")
    kind = base.schema["block"].dataType.simpleString()

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        v = np.stack(pdf["v"])
        label = density_tree(v, least)
        sure = label >= 0
        if not sure.any():
            label[:], sure[:] = 0, True
        names = np.unique(label[sure])
        own = pdf["id"].to_numpy()
        least_key = np.array([own[label == c].min() for c in names])
        if not sure.all():
            centre = np.stack([v[label == c].mean(axis=0) for c in names])
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-6)
            label[~sure] = names[np.argmax(v[~sure] @ centre.T, axis=1)]
        return pd.DataFrame({"block": pdf["block"], "id": own, "cluster": least_key[np.searchsorted(names, label)]})

    small = base.where(F.col("n") <= max(dense, 2 * least - 1)).groupBy("block").applyInPandas(whole, f"block {kind}, id long, cluster long")
    large = base.where(F.col("n") > max(dense, 2 * least - 1))
    done = small if large.isEmpty() else small.unionByName(_large_clusters(large, kind, least, size, neighbours))
    out = done.select(F.col("block").alias(named), F.col("id").alias(key), "cluster")
    return out if by else out.drop(named)


def _large_clusters(rows: DataFrame, kind: str, least: int, size: int, neighbours: int) -> DataFrame:
    edges = spanning_trees(rows, "block", key="id", vector="v", least=least, size=size, neighbours=neighbours)

    def labelled(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, code = np.unique(np.concatenate([pdf["u"], pdf["v"]]), return_inverse=True)
        label = tree_labels(code[: len(pdf)], code[len(pdf) :], pdf["w"].to_numpy(), len(nodes), least)
        if (label < 0).all():
            label[:] = 0
        cluster = pd.Series(nodes).groupby(label).transform("min").to_numpy()
        return pd.DataFrame({"block": pdf["block"].iloc[0], "id": nodes, "cluster": np.where(label < 0, -1, cluster), "out": label < 0})

    labels = written(edges.groupBy("block").applyInPandas(labelled, f"block {kind}, id long, cluster long, out boolean"), "labels")
    sure = labels.where(~F.col("out"))
    vectors = rows.select("block", "id", "v")
    centres = mean_vectors(vectors.join(sure.select("id", "cluster"), "id"), ["block", "cluster"], "v")
    part = F.concat_ws("|", F.col("block").cast("string"), F.pmod(F.xxhash64("id"), F.lit(4096)).cast("string"))
    lost = vectors.join(labels.where("out").select("id"), "id").select(part.alias("tile"), "block", "id", "v", F.lit(-2).cast("long").alias("tree"), F.lit(0.0).alias("core"), F.lit(float("inf")).alias("cap"))
    held = centres.select(F.col("block").cast("string").alias("tile"), F.col("cluster").alias("id"), F.col("centroid").alias("v"), F.lit(-3).cast("long").alias("tree"), F.lit(0.0).alias("core"), F.lit(float("inf")).alias("cap"))
    pairs = lost.select(F.col("tile").alias("a"), F.col("block").cast("string").alias("b"), F.lit(0.0).alias("low")).distinct()
    nearest = met(lost, held, pairs, 1).select("id", F.col("near")[0].alias("cluster"))
    return sure.select("block", "id", "cluster").unionByName(labels.where("out").select("block", "id").join(nearest, "id"))


def cluster_names(clusters: DataFrame, vocabulary: dict[str, Sequence[float]], *, key: str = "cluster", centroid: str = "centroid", n: str = "n") -> DataFrame:
    """(key, name): the largest cluster takes its best label, each next one (the lesser key on ties) its best that is free; when none is, the best with its key.

    Only as many clusters as there are labels can find a free one: these, the largest, are named in one task, and all
    others where they are. The vocabulary is a parameter, of vectors as long as the centroids; ties go to the first label.
    """
    labels = list(vocabulary)
    words = np.stack([np.asarray(vocabulary[x], float) for x in labels])
    rows = clusters.select(F.col(key).alias("key"), F.col(centroid).cast("array<double>").alias("c"), F.col(n).alias("n"))
    first = rows.orderBy(F.desc("n"), "key").limit(len(labels))
    schema = rows.select("key", F.lit("").alias("name")).schema

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        free, names = set(range(len(labels))), []
        pdf = pdf.sort_values(["n", "key"], ascending=[False, True])
        for c in pdf["c"]:
            best = next(x for x in np.argsort(-(words @ np.asarray(c)), kind="stable") if x in free)
            free.discard(best)
            names.append(labels[best])
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "name": names})

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            names = [f"{labels[int(np.argmax(words @ np.asarray(c)))]} {k}" for k, c in zip(pdf["key"], pdf["c"], strict=True)]
            yield pd.DataFrame({"key": pdf["key"], "name": names})

    top = first.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(greedy, schema)
    rest = rows.join(F.broadcast(first.select("key")), "key", "left_anti").mapInPandas(best, schema)
    return top.unionByName(rest).withColumnRenamed("key", key)

"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1. Every document becomes its set of n-gram hashes; equal sets collapse into one vertex.
2. Vertices that could link are brought together without the product. Sets of sizes a and b link only if they differ in
   at most D = (a + b)(1 - s)/(1 + s) n-grams. The hash range is cut into more than D bins, so linked sets agree on all
   of some bin. A bin's content is its signature; sets of similar sizes share one binning. A common passage fills a bin
   alone so rarely that it makes no large group by itself, unlike a single common n-gram. Tasks pack signatures into
   blobs. Linked sets agree on more bins than one: a set leaves signatures of many sets out as long as its other
   bins still hold one of those, so that a common passage does not bring together what else has nothing in common.
   Pairs that share a signature must also pass a bound on part sizes: counted in BUCKETS ranges of the hash, two sets
   differ at least by the sum of the differences of their counts, and pairs beyond D go.
3. Vertices that such pairs connect form blocks. Blocks are cut into tiles; for each pair of tiles the incidence matrices
   are multiplied in slices of columns that both hold, overlap counts are accumulated, and pairs below the bound that
   their sizes give are discarded. A pair of tiles returns a spanning forest of its links and each vertex's links as a
   number, so output is linear in the block, whatever the number of links. Where links need not be counted, tiles of a
   class already found are not paired: a large group of near copies takes its tiles and some heads, not all their pairs.
4. Components of the forests are the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiquarry.llm.textbytes import LOWER, NOT_SPACE, hashes, mix, pieces, shingles, spread, tidy, utf8, words
from lumiquarry.operators.graph import connected_components
from lumiquarry.session import table, written

#: Vertices in a tile of the product, n-grams of a tile, and columns multiplied at once.
TILE, TILE_GRAMS, COLUMNS = 512, 1 << 20, 4096
#: Signatures a task gathers before it packs them.
FLUSH = 1 << 20
#: Bytes of a batch that a task hands on at once: the JVM holds each whole, beside its heap, and Python a second time while it is sent.
HANDED = 1 << 20
#: Ranges of the hash in which a set's n-grams are counted, each up to 255.
BUCKETS = 64
#: Sets of more n-grams are also counted in ranges of about 12 n-grams: in BUCKETS ranges, large sets are alike by chance.
FINE = 1000
#: Vertices of one signature up to which all their pairs are listed, and beyond which it is left out by each vertex that can spare it.
#: If more than GROUP cannot, they are joined in a star instead of comparing counts.
LOCAL_GROUP, GROUP = 32, 4096
#: Where a signature holds its size class, and the class that marks those of a set's first hashes, which cannot be spared.
CLASS_AT, FIRST_HASHES = 16, 255
#: Bits of the filter that says whose texts are read again: its size is fixed, so it can be broadcast; more members mean more texts read in vain.
FILTER = 26
PREFIX_TAG = np.uint64(0xA24BAED4963EE407)


class Bounds:
    """What the similarity percent/100 says about sizes, all in whole numbers."""

    def __init__(self, percent: int, longest: int = 1 << 40):
        self.percent = percent
        lo, los = 1, []
        while lo < longest:
            los.append(lo)
            lo = max(lo + 1, lo * 5 // 4)
        self.lo = np.array(los, np.int64)
        most = np.append(self.lo[1:] - 1, longest)
        #: Sets of a size class, and of those below it that may link with them, differ in at most so many.
        self.apart = 2 * most * (100 - percent) // (100 + percent)
        solved = [self._bins(int(d), max(1, int(lo) * percent // 100)) for d, lo in zip(self.apart, self.lo, strict=True)]
        #: Bins of each class, and the n-grams from which a bin is sent. Linked sets agree on more than ``slack`` bins.
        self.bins, self.least = (np.array(x, np.int64) for x in zip(*solved, strict=True))
        self.slack = self.bins - self.apart - 1

    @staticmethod
    def _bins(apart: int, size: int) -> tuple[int, int]:
        """(bins, least): so many bins that sets of ``size`` or more seldom have more poorer bins than linked sets may leave out.

        Bins of one n-gram are left out too where that takes few bins more: a frequent n-gram alone then never makes a group.
        """
        bins = apart + 1 + np.ceil((apart + 1) * np.linspace(0, 0.8, 161))
        mean = size / bins
        for least, most in ((2, 1.75), (1, 1.35)):
            poor = np.exp(-mean) * (1 + (least - 1) * mean)
            ok = np.flatnonzero((bins * poor + 3 * np.sqrt(bins * poor * (1 - poor)) <= bins - apart - 1) & (bins <= most * (apart + 1)))
            if len(ok):
                return int(bins[ok[0]]), least
        return apart + 2 + apart // 20, 1

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The overlap from which sets of sizes a and b link."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def signatures(self, flat: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signature, row) such that any two linked rows with different sets share one. Rows are ascending hashes flat[place[i]:place[i + 1]]."""
        return self.spared(flat, place)[:2]

    def spared(self, flat: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, row, spare): ``signatures``, and of each row its size class and, in the binnings of this class and those above, how many
        signatures it may leave out: linked rows still share one if each leaves out no more, and leaves out what the other does unless it keeps all.
        """
        n = np.diff(place)
        own = np.searchsorted(self.lo, n, "right") - 1
        top = np.searchsorted(self.lo, n * 100 // self.percent, "right") - 1
        sigs, rows = [], []
        spare = np.full((len(n), int((top - own).max(initial=0)) + 2), -1, np.int32)
        spare[:, 0] = own
        for up in range(spare.shape[1] - 1):
            of = np.flatnonzero((n > 0) & (own + up <= top) & (self.apart[np.maximum(own + up, 0)] > 0))
            if not len(of):
                continue
            k, size = own[of] + up, n[of]
            bins = self.bins[k]
            s = flat[spread(place[of], size)]
            inst = np.repeat(np.arange(len(of)), size)
            bin_ = ((s >> np.uint64(32)) * bins[inst].astype(np.uint64)) >> np.uint64(32)
            new = np.ones(len(s), bool)
            new[1:] = (bin_[1:] != bin_[:-1]) | (inst[1:] != inst[:-1])
            at = np.flatnonzero(new)
            inst = inst[at]
            sig = of_class(mix(np.add.reduceat(mix(s), at) + mix(bin_[at] * np.uint64(1 << 20) + k[inst].astype(np.uint64))), k[inst])
            rich = np.diff(np.append(at, len(s))) >= self.least[k][inst]
            sig, inst = sig[rich], inst[rich]
            sigs.append(sig)
            rows.append(of[inst])
            spare[of, up + 1] = self.slack[k] - bins + np.bincount(inst, minlength=len(of))
            # Two rows that both have more poor bins might agree on poor bins alone: those also share one of their first hashes.
            if (lean := spare[of, up + 1] < 0).any():
                of, k = of[lean], k[lean].astype(np.uint64)
                size = n[of] + (-self.percent * n[of]) // 100 + 1
                sigs.append(of_class(mix(flat[spread(place[of], size)] ^ PREFIX_TAG ^ mix(np.repeat(k, size))), np.array(FIRST_HASHES)))
                rows.append(np.repeat(of, size))
        if not sigs:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), spare
        return np.concatenate(sigs), np.concatenate(rows), spare


def of_class(sig: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The signatures with the size class in them, among the bits that ``squeezed`` leaves."""
    return (sig & ~np.uint64(255 << CLASS_AT)) | (k.astype(np.uint64) << np.uint64(CLASS_AT))


def grams(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8(batch.column("text"))
    data = LOWER[data]
    begins, ends, first = words(data, offsets, NOT_SPACE)
    return shingles(hashes(data, begins, ends), first, size)


def digest(grams_of_row: np.ndarray) -> bytes:
    return hashlib.blake2b(grams_of_row.tobytes(), digest_size=16).digest()


def runs(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (sig, node) pairs, ascending, and the n + 1 places where signatures begin."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[keep], node[keep]
    return sig, node, np.append(np.flatnonzero(np.append(True, sig[1:] != sig[:-1])), len(sig)) if len(sig) else np.zeros(1, np.int64)


def squeezed(sig: np.ndarray, node: np.ndarray) -> bytes:
    """About ten bytes a pair: of the high 48 bits of ascending signatures the steps, in as many bytes as the largest needs, and 48 bits of a node.

    Signatures that agree so far are taken as one, which only adds candidates.
    """
    high = sig >> np.uint64(16)
    step = np.diff(high, prepend=high[:1])
    wide = max(1, -(-int(step.max()).bit_length() // 8))
    pairs = np.concatenate([x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - w :] for x, w in ((step, wide), (node, 6))], axis=1)
    return (int(high[0]) << 16 | wide).to_bytes(8, "big") + pairs.tobytes()


def unsqueezed(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    head = int.from_bytes(blob[:8], "big")
    wide = head & 0xFFFF
    pairs = np.frombuffer(blob, np.uint8, offset=8).reshape(-1, wide + 6)
    step, node = np.zeros((len(pairs), 8), np.uint8), np.zeros((len(pairs), 8), np.uint8)
    step[:, 8 - wide :], node[:, 2:] = pairs[:, :wide], pairs[:, wide:]
    high = np.cumsum(step.view(">u8").ravel().astype(np.uint64), dtype=np.uint64) + np.uint64(head >> 16)
    return high << np.uint64(16), node.view(">u8").ravel().astype(np.int64)


def handed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in slices of about HANDED bytes, or of one row."""
    step = max(1, batch.num_rows * HANDED // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def vertices(digests: list[bytes]) -> np.ndarray:
    """The first 48 bits of digests: the vertex in signatures and edges. Two sets that share them merely share a block."""
    return np.frombuffer(b"".join(x[:6] + b"\0\0" for x in digests), np.int64)


FOUND = "part int, sigs binary, id long, n int, digest binary, counts binary, fine binary, spare array<int>, sig long, node long, hot boolean, u long, v long"


def counts(flat: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many of each row's hashes fall in each of BUCKETS ranges."""
    bucket = (flat >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64) + np.repeat(np.arange(len(place) - 1) * BUCKETS, np.diff(place))
    return np.minimum(np.bincount(bucket, minlength=(len(place) - 1) * BUCKETS), 255).astype(np.uint8).reshape(-1, BUCKETS)


def fine_counts(hashes_: np.ndarray) -> bytes | None:
    """As ``counts``, of one large set, in a power of two of ranges."""
    if len(hashes_) <= FINE:
        return None
    bits = (len(hashes_) // 12).bit_length()
    return np.bincount((hashes_ >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16).tobytes()


def apart_at_least(a: bytes, b: bytes) -> int:
    """In how many n-grams two sets differ at least, by their fine counts."""
    x, y = (np.frombuffer(z, np.uint16).astype(np.int64) for z in (a, b))
    n = min(len(x), len(y))
    return int(np.abs(x.reshape(n, -1).sum(axis=1) - y.reshape(n, -1).sum(axis=1)).sum())


def signed(docs: DataFrame, size: int, bounds: Bounds, parts: int) -> DataFrame:
    """Rows of three kinds: a document's id, n, digest, counts and spare; a signature, one of the nodes that share it, and whether it is hot: of more
    than LOCAL_GROUP; the only two nodes (u, v) of a signature.

    Of rows with one digest some have spare.
    """

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        kinds = {"part": pa.int32(), "sigs": pa.binary(), "id": pa.int64(), "n": pa.int32(), "digest": pa.binary(), "counts": pa.binary(), "fine": pa.binary(), "spare": pa.list_(pa.int32()), "sig": pa.int64(), "node": pa.int64(), "hot": pa.bool_(), "u": pa.int64(), "v": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()], names=list(kinds))

    def own_part(sig: np.ndarray) -> np.ndarray:
        return ((sig >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)

    def packed(sigs: list, nodes: list) -> Iterator[pa.RecordBatch]:
        if not sigs:
            return
        both = np.concatenate(sigs), np.concatenate(nodes)
        sigs.clear()
        nodes.clear()
        sig, node, _ = runs(*both)
        del both
        part = own_part(sig)  # ascending, as sig is
        cut = np.searchsorted(part, np.arange(parts + 1))
        full = np.flatnonzero(np.diff(cut))
        each = max(1, len(full) * HANDED // (12 * len(sig)))
        for at in range(0, len(full), each):
            yield rows(part=full[at : at + each].astype(np.int32), sigs=[squeezed(sig[cut[p] : cut[p + 1]], node[cut[p] : cut[p + 1]]) for p in full[at : at + each]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, seen, held, dealt = [], [], set(), 0, 0
        for batch in pieces(batches, "text"):
            dealt += batch.num_rows
            flat, place = grams(batch, size)
            marks = [digest(flat[a:b]) if b > a else None for a, b in zip(place[:-1], place[1:], strict=True)]
            id_ = batch.column("id")
            fresh = []
            for k, (m, i) in enumerate(zip(marks, id_.to_pylist(), strict=True)):
                if m and i is not None and m not in seen:
                    seen.add(m)
                    fresh.append(k)
            fresh = np.array(fresh, np.int64)
            count = np.diff(place)[fresh]
            sig, row, spare = bounds.spared(flat[spread(place[fresh], count)] if len(fresh) else flat[:0], np.concatenate([[0], np.cumsum(count)]).astype(np.int64))
            spares = dict(zip(fresh.tolist(), spare.tolist(), strict=True))
            yield rows(part=(dealt + np.arange(len(marks))) % parts, id=id_, n=np.diff(place).astype(np.int32), digest=marks, counts=[x.tobytes() for x in counts(flat, place)], fine=[fine_counts(flat[a:b]) for a, b in zip(place[:-1], place[1:], strict=True)], spare=[spares.get(k) for k in range(len(marks))])
            if len(sig):
                sigs.append(sig)
                nodes.append(vertices([marks[k] for k in fresh])[row])
                held += len(sig)
            if held > FLUSH:
                yield from packed(sigs, nodes)
                sigs, nodes, held, seen = [], [], 0, set()
        yield from packed(sigs, nodes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = []
        for batch in batches:
            sigs = batch.column("sigs")
            blobs += [x.as_py() for x in sigs.drop_null()]
            rest = batch.filter(sigs.is_null())
            if rest.num_rows:
                yield rest
        if blobs:
            pairs = [np.concatenate(x) for x in zip(*map(unsqueezed, blobs), strict=True)]
            del blobs
            sig, node, place = runs(*pairs)
            del pairs
            size = np.diff(place)
            if len(two := place[:-1][size == 2]):
                two = np.unique(np.stack([node[two], node[two + 1]], axis=1), axis=0)
                yield from handed(rows(u=two[:, 0], v=two[:, 1]))
            size = np.repeat(size, size)
            if (keep := size > 2).any():
                yield from handed(rows(sig=sig[keep].view(np.int64), node=node[keep], hot=size[keep] > LOCAL_GROUP))

    return docs.mapInArrow(tidy(run), FOUND).repartition(parts, "part").mapInArrow(tidy(meet), FOUND)


def passing(bounds: Bounds):
    """Whether the sets i and j, by their sizes ``n`` and counts ``c``, may link."""

    def passes(n: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = (n[i] + n[j]) * (100 - bounds.percent) // (100 + bounds.percent)
        apart = np.concatenate([np.abs(c[i[k : k + 65536]] - c[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        return (apart <= most) & (np.minimum(n[i], n[j]) * 100 >= bounds.percent * np.maximum(n[i], n[j]))

    return passes


def counted(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16)


def lone_pairs(bounds: Bounds):
    """Of rows (u, v, nu, nv, cu, cv) the edges (u, v, fine) that pass the bounds on sizes."""
    passes = passing(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.concatenate([b.column("nu").to_numpy(), b.column("nv").to_numpy()]).astype(np.int64)
            at = np.arange(b.num_rows)
            ok = passes(n, np.concatenate([counted(b.column("cu")), counted(b.column("cv"))]), at, at + b.num_rows)
            large = np.minimum(n[: b.num_rows], n[b.num_rows :]) > FINE
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(large)], names=["u", "v", "fine"]).filter(pa.array(ok))

    return run


def near_pairs(bounds: Bounds):
    """Of rows (sig, node, n, counts), those of one signature in one task: edges (u, v, fine) of nodes that share one and pass the bounds on sizes.

    Edges are a spanning forest, but for pairs of large sets in small groups, which are all there, for their fine counts.
    """
    passes = passing(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        known, at = np.unique(t["node"].to_numpy(), return_inverse=True)
        sig, at, place = runs(t["sig"].to_numpy(), at)
        _, first = np.unique(t["node"].to_numpy(), return_index=True)
        n = t["n"].to_numpy()[first].astype(np.int64)
        c = counted(t["counts"].take(pa.array(first)))
        size, pairs = np.diff(place), []
        for g in range(2, min(LOCAL_GROUP, int(size.max())) + 1):
            of = at[spread(place[:-1][size == g], np.full((size == g).sum(), g))].reshape(-1, g)
            i, j = np.triu_indices(g, 1)
            pairs.append(np.stack([of[:, i].ravel(), of[:, j].ravel()], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        pairs = pairs[passes(n, c, pairs[:, 0], pairs[:, 1])]
        large = np.minimum(n[pairs[:, 0]], n[pairs[:, 1]]) > FINE
        if large.any():
            e = known[pairs[large]]
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array(np.ones(len(e), bool))], names=["u", "v", "fine"])
        pairs = pairs[~large]
        root = np.arange(len(known))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges = []
        for a, b in pairs.tolist():
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((a, b))
        for k in np.flatnonzero(size > LOCAL_GROUP):
            own = at[place[k] : place[k + 1]]
            top = np.array([find(x) for x in own])
            for x in range(len(own)):  # against all nodes after it that are not yet connected with it
                rest = np.flatnonzero(top[x + 1 :] != top[x]) + x + 1
                if len(rest) and (ok := rest[passes(n, c, np.full(len(rest), own[x]), own[rest])]).size:
                    for y in ok:
                        a, b = find(own[x]), find(own[y])
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            edges.append((a, b))
                    top = np.array([find(z) for z in top])
        if edges:
            e = known[np.array(edges)]
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array(np.zeros(len(e), bool))], names=["u", "v", "fine"])

    return run


def unspared(hot: DataFrame, vertex: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of hot signatures (sig, node) those that ``vertex`` (node, spare) cannot leave out: (sig, node) to be compared, and edges (u, v) of stars.

    A vertex leaves all its hot signatures of a binning out or none. If one of two linked vertices leaves them out, they agree on another of
    its bins, as it can spare those; if neither does, they share what they shared.
    """
    hot = hot.withColumn("k", F.shiftright("sig", CLASS_AT).bitwiseAND(255).cast("int"))
    spare = F.coalesce(F.get("spare", F.col("k") - F.get("spare", F.lit(0)) + 1), F.lit(-1))
    kept = hot.groupBy("node", "k").agg(F.count("*").alias("n")).join(vertex, "node").where((F.col("k") == FIRST_HASHES) | (F.col("n") >= spare))
    hot = written(hot.join(kept.select("node", "k"), ["node", "k"], "left_semi").select("sig", "node"), "hot")
    of = hot.groupBy("sig").agg(F.count("*").alias("n"), F.min("node").alias("u"))
    both = hot.join(of.where("n > 1"), "sig")
    return both.where(F.col("n") <= GROUP).select("sig", "node"), both.where((F.col("n") > GROUP) & (F.col("u") < F.col("node"))).select("u", F.col("node").alias("v"))


def fine_pairs(bounds: Bounds):
    """Of rows (u, v, nu, nv, fu, fv) the pairs (u, v) whose fine counts do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (b.column("nu").to_numpy().astype(np.int64) + b.column("nv").to_numpy()) * (100 - bounds.percent) // (100 + bounds.percent)
            ok = [apart_at_least(x, y) <= m for x, y, m in zip(b.column("fu").to_pylist(), b.column("fv").to_pylist(), most, strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def product(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], bounds: Bounds) -> np.ndarray:
    """Which rows of the tiles link: overlap counts from slices of the columns that both tiles hold, against the sizes' bound."""
    (fl, pl), (fr, pr) = left, right
    nl, nr = np.diff(pl), np.diff(pr)
    both = np.intersect1d(np.unique(fl), np.unique(fr), assume_unique=True)
    near = (np.minimum(nl[:, None], nr) * 100 >= bounds.percent * np.maximum(nl[:, None], nr)) if len(both) else np.zeros((len(nl), len(nr)), bool)
    if not near.any():
        return near
    if fl is fr:  # a column that one row alone holds adds to no pair
        of, count = np.unique(fl, return_counts=True)
        both = of[count > 1]

    def held(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        column = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        ok = both[column] == flat if len(both) else np.zeros(len(flat), bool)
        return np.repeat(np.arange(len(n)), n)[ok], column[ok]

    rl, cl = held(fl, nl)
    rr, cr = held(fr, nr)
    overlap = np.zeros((len(nl), len(nr)), np.float32)
    for at in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - at)
        a, b = np.zeros((len(nl), width), np.float32), np.zeros((len(nr), width), np.float32)
        ok = (cl >= at) & (cl < at + width)
        a[rl[ok], cl[ok] - at] = 1
        ok = (cr >= at) & (cr < at + width)
        b[rr[ok], cr[ok] - at] = 1
        overlap += a @ b.T
    return near & (overlap >= bounds.needed(nl[:, None], nr))


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges between ids that connect what ``links`` connects, fewer than there are rows."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    out = []
    for i in range(len(left)):
        for j in np.flatnonzero(links[i]):
            a, b = find(int(left[i])), find(int(right[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(left[i]), int(right[j])))
    return out


def tiled(sets: DataFrame, side: Column | None = None) -> DataFrame:
    """``sets`` (block, rep, copies, grams) with ``mine``, the tile of each in its block, and ``meets``, the tiles whose products it is in: all.

    With ``side`` (boolean) the sets where it is false have tiles of their own, and no tile of those where it holds meets another of them.
    """
    kind = F.lit(False) if side is None else side
    sets = sets.withColumn("_side", kind)
    need = F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.octet_length("grams") / 8) / TILE_GRAMS)).cast("int")
    tiles = sets.groupBy("block", "_side").agg(need.alias("_n")).groupBy("block").agg(F.sum(F.when(F.col("_side"), F.col("_n")).otherwise(0)).cast("int").alias("_a"), F.sum(F.when(~F.col("_side"), F.col("_n")).otherwise(0)).cast("int").alias("_b"))
    at = F.pmod(F.xxhash64("rep"), F.when(F.col("_side"), F.col("_a")).otherwise(F.col("_b"))).cast("int")
    rest = F.when(F.col("_b") > 0, F.sequence(F.col("_a"), F.col("_a") + F.col("_b") - 1)).otherwise(F.array().cast("array<int>"))
    every = F.sequence(F.lit(0), F.col("_a") + F.col("_b") - 1)
    out = sets.join(tiles, "block").withColumn("mine", F.when(F.col("_side"), at).otherwise(F.col("_a") + at)).withColumn("meets", F.when(F.col("_side"), rest).otherwise(every))
    return out.select("block", "rep", "copies", "grams", "mine", "meets", (F.col("_a") + F.col("_b")).alias("tiles"))


def products(sets: DataFrame, bounds: Bounds) -> DataFrame:
    """Of sets with ``mine`` and ``meets``: edges (u, v) that span the links of each pair of tiles that meet, and (u, links) of each set there."""

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        sides = []
        for t in {i: 0, j: 1}:
            part = pdf[pdf["mine"] == t]
            place = np.concatenate([[0], np.cumsum([len(x) // 8 for x in part["grams"]])]).astype(np.int64)
            sides.append((part["rep"].to_numpy(), part["copies"].to_numpy(), (np.frombuffer(b"".join(part["grams"]), np.uint64), place)))
        (a, na, ga), (b, nb, gb) = sides[0], sides[-1]
        links = product(ga, gb, bounds)
        if i == j:
            np.fill_diagonal(links, False)
        edges = forest(links, a, b)
        degrees = list(zip(a.tolist(), (links @ nb).tolist(), strict=True)) + ([] if i == j else list(zip(b.tolist(), (links.T @ na).tolist(), strict=True)))
        return pd.DataFrame({"u": [x for x, _ in edges] + [x for x, d in degrees if d], "v": [y for _, y in edges] + [None for _, d in degrees if d], "links": [None for _ in edges] + [d for _, d in degrees if d]}).astype("Int64")

    pairs = sets.withColumn("_other", F.explode("meets")).select("block", F.least("mine", "_other").alias("i"), F.greatest("mine", "_other").alias("j"), "mine", "rep", "copies", "grams")
    return pairs.groupBy("block", "i", "j").applyInPandas(multiply, "u long, v long, links long")


def spanned(sets: DataFrame, bounds: Bounds) -> DataFrame:
    """Edges (u, v) that connect what the links of ``sets`` (block, rep, copies, grams, mine, tiles) connect, without all pairs of a class.

    1. Each tile alone. 2. In blocks of several tiles, one set of each class of each tile, against each other. 3. Whatever
    is not in the block's largest class by then, against all sets of the block. What is never compared is within that
    class, where further links connect nothing new.
    """
    edges = lambda df, what: written(products(df, bounds).where("v is not null"), what)
    found = edges(sets.withColumn("meets", F.array("mine")), "links")
    large = sets.where("tiles > 1")
    if large.isEmpty():
        return found

    def classed(done: DataFrame) -> DataFrame:
        classes = connected_components(done, "u", "v").select(F.col("node").alias("rep"), "component")
        return large.select("block", "rep", "copies", "grams", "mine").join(classes, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    heads = classed(found).groupBy("block", "mine", "component").agg(F.min_by(F.struct("rep", "copies", "grams"), "rep").alias("h"))
    found = found.union(edges(tiled(heads.select("block", "h.rep", "h.copies", "h.grams")), "links"))
    now = written(classed(found), "classed")
    most = now.groupBy("block", "component").agg(F.count("*").alias("n")).groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("classes"))
    now = now.join(most.where("classes > 1").drop("classes"), "block")
    return found.union(edges(tiled(now.drop("mine"), side=F.col("component") == F.col("most")), "links"))


def id_bit(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(1 << FILTER))


def id_filter(ids: DataFrame):
    """A broadcast bit for each hash of an id, set where one of the frame's only column has it: 8 MB whatever the frame."""

    def bits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << 15, bool)
        own[pdf["bit"].to_numpy() & 0x7FFF] = True
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.packbits(own).tobytes()]})

    of = ids.select(id_bit(ids.columns[0]).alias("bit")).distinct().withColumn("chunk", F.shiftright("bit", 15).cast("int"))
    chosen = np.zeros((1 << (FILTER - 15), 1 << 12), np.uint8)
    for chunk, own in of.groupBy("chunk").applyInPandas(bits, "chunk int, bits binary").toLocalIterator():
        chosen[chunk] = np.frombuffer(own, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(chosen.ravel())


def may_hold(chosen: np.ndarray, bit: pa.Array) -> pa.Array:
    at = bit.fill_null(0).to_numpy()
    return pa.array(((chosen[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1) & bit.is_valid().to_numpy(zero_copy_only=False))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, links: bool = True) -> DataFrame:
    """Classes of documents by links of Jaccard similarity percent/100 or more between sets of ``size``-word n-grams.

    Returns a row per row of ``docs``: ``id_col``, n_shingles (size of the set), component_id (the smallest id that links
    reach, the row's own included) and n_links (rows linked with it directly, copies included). Words are what ASCII white
    space separates, A-Z lowered; a text of fewer words has its whole sequence as one n-gram. Counting links takes all
    pairs of tiles of a block; without ``links`` n_links is null, and pairs within a class already found are spared.

    Ids are whole numbers. Null texts and texts without words have an empty set and link with nothing. Rows with a null
    id link with nothing and have component_id null. Rows that repeat an id with another text are each classed by their
    text; classes that meet in an id which is the smallest of both are one. Further columns are not read; an empty table
    gives no rows. Whole texts and all links between different sets count; equal sets are one vertex and never paired.
    """
    spark = docs.sparkSession
    bounds = Bounds(percent)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = written(signed(base, size, bounds, parts), "ngrams")
    sets = found.where("n is not null").select("id", "n", "digest")
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("n", "counts", "fine", "spare")]
    vertex = found.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *first)

    def node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vertices(b.column("digest").to_pylist()))], names=[*b.schema.names, "node"])

    # Written, as are large pairs below: a task of two Python steps takes two workers, which an executor keeps beside its heap until they have been idle for long.
    numbered = written(vertex.mapInArrow(tidy(node), "digest binary, rep long, copies long, n int, counts binary, fine binary, spare array<int>, node long"), "vertices")
    few, star = unspared(found.where("hot").select("sig", "node"), numbered.select("node", "spare"))
    shared = found.where("not hot").select("sig", "node").union(few).join(numbered.select("node", "n", "counts"), "node")
    pairs = shared.repartition(parts, "sig").mapInArrow(tidy(near_pairs(bounds)), "u long, v long, fine boolean")
    by_node = numbered.select("node", "n", "counts")
    lone = found.where("u is not null").select("u", "v").distinct().join(by_node.toDF("u", "nu", "cu"), "u").join(by_node.toDF("v", "nv", "cv"), "v")
    pairs = pairs.union(lone.mapInArrow(tidy(lone_pairs(bounds)), "u long, v long, fine boolean"))
    pairs = written(pairs.union(star.withColumn("fine", F.lit(False))).distinct(), "pairs")
    # Vertices that share 48 bits are two rows here: any of their pairs that passes keeps the edge.
    fine = numbered.where("fine is not null").select("node", "n", "fine")
    large = pairs.where("fine").join(fine.toDF("u", "nu", "fu"), "u").join(fine.toDF("v", "nv", "fv"), "v")
    large = written(large.select("u", "v", "nu", "nv", "fu", "fv").mapInArrow(tidy(fine_pairs(bounds)), "u long, v long"), "large")
    blocks = connected_components(pairs.where("not fine").select("u", "v").union(large), "u", "v")
    members = written(numbered.join(blocks, "node").select("digest", "rep", "copies", "n", F.col("component").alias("block")), "blocks")
    sent = id_filter(members.select("rep"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(iter([b.filter(may_hold(sent.value, b.column("bit")))]), "text"):
                flat, place = grams(part, size)
                own = [flat[x:y] for x, y in zip(place[:-1], place[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([digest(x) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], names=["rep", "digest", "grams"])

    texts = base.where("id is not null").withColumn("bit", id_bit("id")).mapInArrow(tidy(sets_of), "rep long, digest binary, grams binary")
    # The tiles are counted on the narrow members, so that texts are read again once and n-grams are written once.
    tiles = members.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / TILE_GRAMS)).cast("int").alias("tiles"))
    own = texts.join(members.join(tiles, "block").drop("n"), ["rep", "digest"]).dropDuplicates(["rep", "digest"]).drop("digest")
    own = own.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    if links:
        done = written(products(own.withColumn("meets", F.sequence(F.lit(0), F.col("tiles") - 1)), bounds), "links")
    else:
        done = spanned(written(own, "tiles"), bounds)
    classes = connected_components(done.where("v is not null"), "u", "v").select(F.col("node").alias("rep"), "component")
    degree = (done if links else done.withColumn("links", F.lit(None).cast("long"))).where("links is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    by_set = vertex.join(classes, "rep", "left").join(degree, "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
    )
    return sets.join(by_set, "digest", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
        F.when(F.lit(links), F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents, with all their columns, without those that a smaller id of their class stands for. See ``jaccard_components``.

    Of rows that repeat the standing id, all stay; rows with a null id stay.
    """
    classes = jaccard_components(docs, id_col=id_col, links=False, **how)
    dropped = written(classes.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("id")).distinct(), "dropped")
    sent = id_filter(dropped)
    mark = "_bit"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.when(F.col(id_col).isNotNull(), id_bit(id_col)))

    def held(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = may_hold(sent.value, b.column(mark))
                yield b.filter(hit if wanted else pc.invert(hit)).drop_columns([mark])

        return run

    # Only texts that the filter finds are shuffled to be held against the ids; the others stay where they are.
    found = marked.mapInArrow(tidy(held(True)), docs.schema)
    return marked.mapInArrow(tidy(held(False)), docs.schema).union(found.join(dropped, found[id_col] == dropped["id"], "left_anti"))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: classes by 4-word shingles and a similarity of 0.85. See ``jaccard_components`` for nulls and repeats."""
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85, links=False).select("doc_id", "n_shingles", "component_id")

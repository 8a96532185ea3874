"""Benchmark decontamination: suffix arrays over the training words, searched for every suffix of the benchmark.

The documents of a task are cut into shards of about SHARD_BYTES of text. Each shard numbers its distinct words and
sorts all its word positions by the words that follow, to at least ``window`` words deep; every benchmark suffix that can
open a window is then located by binary search, all of them in step, which gives the range of all its verbatim
occurrences. No row leaves its task: nothing is shuffled, and a hot passage is a long range and no more.

The benchmark has a suffix array too, sorted in full. Equal windows stand together in it; and where a verbatim stretch
begins in a document, its words narrow a range of that array until none is left: the depth is the longest match there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiquarry.llm.textbytes import ALNUM, LOWER, hashes, pieces, spread, tidy, utf8, words
from lumiquarry.session import table, written

SHARD_BYTES = 4 << 20
#: Benchmark text that is broadcast at once; a larger benchmark is searched for block by block.
BLOCK_BYTES = 8 << 20


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``ids`` (non-negative integers) ordered by the ids from there on, ``depth`` of them at least; beyond the end is less than any.

    The first sort packs as many ids as 63 bits hold; then prefixes double, and only positions still tied are sorted anew.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    bits = int(ids.max() + 1).bit_length()
    covered = max(1, min(depth, 63 // bits))
    key = np.zeros(n, np.uint64)
    for k in range(covered):
        key <<= np.uint64(bits)
        key[: n - min(k, n)] += ids[min(k, n) :].astype(np.uint64) + np.uint64(1)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while covered < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = order[slots]
        beyond = at + covered
        key = (rank[at].astype(np.uint64) << np.uint64(32)) + np.where(beyond < n, rank[np.minimum(beyond, n - 1)] + 1, 0).astype(np.uint64)
        by = np.argsort(key)
        order[slots] = at = at[by]
        key = key[by]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[slots] = fresh
        rank[at] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        covered *= 2
    return order


def narrowed(order: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of the ranges [lo, hi) of ``order`` whose suffixes have the id ``want`` at ``depth``; they agree up to there."""
    n = len(ids)

    def bound(above: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while len(go := np.flatnonzero(a < b)):
            mid = (a[go] + b[go]) >> 1
            place = order[mid] + depth
            have = np.where(place < n, ids[np.minimum(place, n - 1)], -1)
            right = (have < want[go]) | (above & (have == want[go]))
            a[go], b[go] = np.where(right, mid + 1, a[go]), np.where(right, b[go], mid)
        return a

    return bound(False), bound(True)


def ranges(order: np.ndarray, ids: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``order`` the positions lie that begin with each query (a row of ``queries``, as long as ``lengths`` says)."""
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(order), np.int64)
    for depth in range(queries.shape[1]):
        live = np.flatnonzero((lengths > depth) & (lo < hi))
        if not len(live):
            break
        lo[live], hi[live] = narrowed(order, ids, lo[live], hi[live], depth, queries[live, depth])
    return lo, hi


class Windows:
    """One block of benchmark items: its suffix array, its distinct windows and the items that hold each.

    ``seq`` holds the items' words as numbers from 1 on in the order of their hashes, a 0 after each item.
    """

    def __init__(self, items: list[tuple[object, str]], window: int):
        data, offsets = utf8(pa.array([x for _, x in items], pa.string()))
        data = LOWER[data]
        begins, ends, first = words(data, offsets, ALNUM)
        self.width, self.names = window, np.array([str(i) for i, _ in items], object)
        self.vocabulary, ids = np.unique(hashes(data, begins, ends), return_inverse=True)
        size = np.diff(first)
        item = np.repeat(np.arange(len(size)), size)
        self.seq = np.zeros(len(ids) + len(size), np.int64)
        self.seq[np.arange(len(ids)) + item] = ids + 1
        self.order = suffix_array(self.seq, max(window, int(size.max(initial=0)) + 1))
        base, of = first[:-1] + np.arange(len(size)), np.repeat(np.arange(len(size)), size + 1)
        # A window opens wherever ``window`` words are left of the item, and where a shorter item begins.
        left = base[of] + size[of] - np.arange(len(self.seq))
        opens = (left >= window) | ((size[of] < window) & (left == size[of]) & (left > 0))
        at = self.order[opens[self.order]]  # equal windows are neighbours, but for those of items that end in between
        deep = np.minimum(left[at], window)
        new = np.arange(len(at)) == 0
        for d in range(window if len(at) else 0):
            word = self.seq[np.minimum(at + d, len(self.seq) - 1)]
            new[1:] |= (word[1:] != word[:-1]) & (np.maximum(deep[1:], deep[:-1]) > d)
        kind = np.cumsum(new) - 1
        self.lengths, self.starts = deep[new], at[new]
        held = np.unique(np.stack([kind, of[at]], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
        self.held, self.held_at = held[:, 1], np.searchsorted(held[:, 0], np.arange(len(self.lengths) + 1))
        #: How often each window occurs, and how often one does right after another.
        self.times = np.bincount(kind, minlength=len(self.lengths))
        window_at = np.full(len(self.seq) + 1, -1)
        window_at[at[deep == window]] = kind[deep == window]
        a, b = window_at[:-1], window_at[1:]
        self.after, self.after_times = np.unique((a * len(self.lengths) + b)[(a >= 0) & (b >= 0)], return_counts=True)

    def find(self, order: np.ndarray, ids: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position, window) of the shard where a window begins. ``vocabulary``: the hashes of the shard's words, ascending."""
        if not len(self.lengths) or not len(vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(vocabulary, self.vocabulary), len(vocabulary) - 1)
        number = np.concatenate([[-1], np.where(vocabulary[place] == self.vocabulary, place + 1, 0)])  # of a benchmark word in the shard
        can = np.arange(len(self.starts))
        for d in range(self.width):  # few windows have all their words in the shard
            can = can[(self.lengths[can] <= d) | (number[self.seq[np.minimum(self.starts[can] + d, len(self.seq) - 1)]] > 0)]
        rows = number[self.seq[np.minimum(self.starts[can, None] + np.arange(self.width), len(self.seq) - 1)]]
        lo, hi = ranges(order, ids, rows, self.lengths[can])
        return order[spread(lo, hi - lo)], np.repeat(can, hi - lo)

    def begins(self, at: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Which of the finds, ordered by position, may begin a longest match: those that not every occurrence continues from the word before."""
        first = np.searchsorted(at, at)  # finds of one position stand together
        before = np.searchsorted(at, at - 1)
        code = window[np.minimum(before, max(0, len(at) - 1))] * len(self.lengths) + window
        k = np.minimum(np.searchsorted(self.after, code), max(0, len(self.after) - 1))
        known = (self.after[k] == code) if len(self.after) else np.zeros(len(at), bool)
        alone = (before + 1 == first) & (at[np.minimum(before, max(0, len(at) - 1))] == at - 1)  # one find at the word before
        return ~(alone & known & (np.where(known, self.after_times[k] if len(self.after) else 0, 0) == self.times[window]))

    def longest(self, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How many words from each position on stand verbatim in some item. ``ids``: the document's words as benchmark numbers, below 0 for others."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        out, live, depth = np.zeros(len(at), np.int64), np.arange(len(at)), 0
        while len(live):
            place = at[live] + depth
            want = np.where(place < len(ids), ids[np.minimum(place, len(ids) - 1)], -1)
            lo[live], hi[live] = narrowed(self.order, self.seq, lo[live], hi[live], depth, want)
            live = live[(lo[live] < hi[live]) & (want > 0)]
            depth += 1
            out[live] = depth
        return out


def search(batch: pa.RecordBatch, found: Windows) -> Iterator[tuple[int, np.ndarray, set, int, int]]:
    """For each row: its words, the sorted word positions that are hit, the items, the longest verbatim match and where it begins."""
    data, offsets = utf8(batch.column("text"))
    data = LOWER[data]
    begins, ends, first = words(data, offsets, ALNUM)
    n = batch.num_rows
    vocabulary, ids = np.unique(hashes(data, begins, ends), return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(first))
    seq = np.zeros(len(ids) + n, np.int64)  # a 0 ends each row, so that no match spans two
    seq[np.arange(len(ids)) + row] = ids + 1
    at, window = found.find(suffix_array(seq, found.width), seq, vocabulary)
    base = first + np.arange(n + 1)
    hit = np.zeros(len(seq) + 1, np.int64)
    np.add.at(hit, at, 1)
    np.add.at(hit, at + found.lengths[window], -1)
    hit = np.cumsum(hit)[:-1] > 0
    by = np.lexsort((window, at))
    at, window = at[by], window[by]
    starts = np.unique(at[found.begins(at, window)])
    place = np.minimum(np.searchsorted(found.vocabulary, vocabulary), max(0, len(found.vocabulary) - 1))
    known = np.where(found.vocabulary[place] == vocabulary, place + 1, -1) if len(found.vocabulary) else np.full(len(vocabulary), -1)
    deep = found.longest(starts, np.concatenate([[-1], known])[seq])
    where, start_at = np.searchsorted(at, base), np.searchsorted(starts, base)
    for i in range(n):
        if where[i] == where[i + 1]:
            yield int(first[i + 1] - first[i]), np.zeros(0, np.int64), set(), 0, -1
            continue
        kinds = np.unique(window[where[i] : where[i + 1]])
        items = set(found.names[np.unique(found.held[spread(found.held_at[kinds], np.diff(found.held_at)[kinds])])])
        own = deep[start_at[i] : start_at[i + 1]]
        best = int(np.argmax(own))
        yield int(first[i + 1] - first[i]), np.flatnonzero(hit[base[i] : base[i + 1]]), items, int(own[best]), int(starts[start_at[i] + best] - base[i])


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for item, text in benchmark.toLocalIterator():
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """What of each document stands verbatim in the benchmark.

    Words are runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII. A window is ``window`` consecutive
    words of an item, or all words of a shorter one. Returns a row per row of ``docs``: ``id_col``, n_words, n_hit (words
    inside any occurrence of a window), items (ids as strings, sorted as strings), longest_match (of the stretches that
    begin with a window, the most words that stand verbatim in one item; 0 without) and match_at (its first word, from 0,
    the first of several; -1 without).

    Null texts and texts without words have n_words 0 and hit nothing; items without words, or with a null id or text,
    have no windows; equal ids of items count once; repeated documents are answered each. Further columns of either
    table are not read. A whole document is in one shard, so memory follows the longest text. The benchmark is broadcast
    in blocks of ``block_bytes`` at most; where it has several, each block's finds are written before the next.
    """
    return _overlap(docs, benchmark, (), id_col, text_col, item_col, item_text, window, block_bytes).withColumnRenamed("id", id_col)


def _overlap(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...], id_col: str, text_col: str, item_col: str, item_text: str, window: int, block_bytes: int) -> DataFrame:
    """``benchmark_overlap`` with the id as "id" and columns ``keep`` of ``docs`` as "kept_" and their name."""
    spark = docs.sparkSession
    items = benchmark.select(item_col, item_text).where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull())
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    base = df.schema
    df = df.withColumns({"n_words": F.lit(0), "hits": F.lit(None).cast("binary"), "items": F.lit(None).cast("array<string>"), "longest": F.lit(0), "place": F.lit(-1)})
    schema = df.schema
    for k, block in enumerate(blocks(items, block_bytes)):
        found = spark.sparkContext.broadcast(Windows(block, window))

        def run(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, "text", SHARD_BYTES):
                n, hits, names, longest, place = [], [], [], [], []
                old = [batch.column(c).to_pylist() for c in ("hits", "items", "longest", "place")]
                for (count, at, own, long, begin), h, i, m, p in zip(search(batch, found.value), *old, strict=True):
                    if h is not None:
                        at = np.union1d(at, np.frombuffer(h, np.int64))
                        own |= set(i)
                        long, begin = max((long, begin), (m, p), key=lambda x: (x[0], -x[1]))
                    n.append(count)
                    hits.append(at.astype(np.int64).tobytes() if len(at) else None)
                    names.append(sorted(own) if own else None)
                    longest.append(long)
                    place.append(begin)
                fixed = [batch.column(c) for c in base.names]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(n, pa.int32()), pa.array(hits, pa.binary()), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int32()), pa.array(place, pa.int32())], names=schema.names)

        df = (written(df, "overlap") if k else df).mapInArrow(tidy(run), schema)
    return df.select(
        "id", F.col("n_words").cast("long").alias("n_words"), F.coalesce((F.octet_length("hits") / 8).cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("longest").alias("longest_match"), F.col("place").alias("match_at"), *[f"kept_{c}" for c in keep],
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark. See ``benchmark_overlap``."""
    found = _overlap(docs, benchmark, tuple(docs.columns), id_col, text_col, item_col, item_text, window, block_bytes)
    return found.where("n_hit = 0").select(*[F.col(f"kept_{c}").alias(c) for c in docs.columns])


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document. Null texts have no words."""
    out = benchmark_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

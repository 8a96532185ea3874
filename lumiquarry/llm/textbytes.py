"""Texts as UTF-8 bytes in numpy: slices of Arrow batches, words and their hashes, ragged gathers."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Lower case for A-Z alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space ends: all but space and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of lower-cased text that are digits, a-z or beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: The session's setting of rows in an Arrow batch, its value where nobody set it, and the one for texts.
BATCH_KEY, UNSET, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"

STEP, M1, M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Words of more bytes are hashed one by one.
LONG = 256
#: What is left of eight bytes of which so many count.
PART = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow over texts: it gives freed memory back to the system at its end, as workers wait beside others that need it.

    Unless the session says otherwise, an Arrow batch gets BATCH_ROWS rows instead of ten thousand: texts are long.
    """
    spark = SparkSession.getActiveSession()
    if spark and spark.conf.get(BATCH_KEY, UNSET) == UNSET:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)

    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in turn, in slices of at most ``most`` bytes of text or of one row."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and the n + 1 places where its rows begin; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    _, places, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word begins and ends, and the n + 1 words that begin the rows. ``inside``: which bytes are of words."""
    w = np.zeros(len(data) + 2, bool)
    w[1:-1] = inside[data]
    begins, ends = w[1:-1] & ~w[:-2], w[1:-1] & ~w[2:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] |= w[1:-1][edge]  # no word spans two rows
    ends[edge - 1] |= w[1:-1][edge - 1]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number, zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes of all words at a time; words beyond LONG bytes by BLAKE2.

    Steps are nonlinear, so words do not collide by a pattern of their bytes; of words of up to eight bytes, those of one
    length never do.
    """
    n = ends - begins
    at = eights(data)
    out = mix((n + 1).astype(np.uint64) * STEP)
    short = n <= LONG
    live = np.flatnonzero(short & (n > 0))
    k = 0
    while len(live):
        out[live] = mix(out[live] ^ (at[begins[live] + k] & PART[np.minimum(n[live] - k, 8)]))
        k += 8
        live = live[n[live] > k]
    for i in np.flatnonzero(~short):
        out[i] = int.from_bytes(hashlib.blake2b(data[begins[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_bytes(a: np.ndarray, a_begins: np.ndarray, b: np.ndarray, b_begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n[i] bytes of ``a`` from a_begins[i] on are those of ``b`` from b_begins[i] on."""
    x, y = eights(a), eights(b)
    out = np.ones(len(n), bool)
    live, k = np.flatnonzero(n > 0), 0
    while len(live) and k < LONG:
        out[live] = (x[a_begins[live] + k] ^ y[b_begins[live] + k]) & PART[np.minimum(n[live] - k, 8)] == 0
        k += 8
        live = live[out[live] & (n[live] > k)]
    for i in live:
        out[i] = a[a_begins[i] + k : a_begins[i] + n[i]].tobytes() == b[b_begins[i] + k : b_begins[i] + n[i]].tobytes()
    return out


def distinct(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct word its hash, ascending, and one place in ``begins``; and of each word which of them it is. Told apart by bytes."""
    hash_, where, inverse = np.unique(hashes(data, begins, ends), return_index=True, return_inverse=True)
    n, first = ends - begins, where[inverse]
    odd = n != n[first]
    odd[~odd] = ~same_bytes(data, begins[~odd], data, begins[first[~odd]], n[~odd])
    if not odd.any():
        return hash_, where, inverse
    more: dict[bytes, int] = {}  # words whose hash another word has too
    new = len(hash_)
    for i in np.flatnonzero(odd):
        inverse[i] = more.setdefault(data[begins[i] : ends[i]].tobytes(), new + len(more))
    own = inverse[odd]
    _, at = np.unique(own, return_index=True)
    where = np.concatenate([where, np.flatnonzero(odd)[at]])
    hash_ = np.concatenate([hash_, hash_[np.searchsorted(hash_, hashes(data, begins[where[new:]], ends[where[new:]]))]])
    order = np.argsort(hash_, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return hash_[order], where[order], back[inverse]


class Memo:
    """What words became, remembered by their bytes: a 64-bit hash finds a word, its bytes decide."""

    def __init__(self, most: int):
        self.most = most
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.data, self.begins, self.sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, hash_: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each word, -1 where it is not held."""
        out = np.full(len(hash_), -1, np.int64)
        if len(self.hash):
            place = np.minimum(np.searchsorted(self.hash, hash_), len(self.hash) - 1)
            near = np.flatnonzero(self.hash[place] == hash_)
            slot = self.slot[place[near]]
            ok = self.sizes[slot] == (ends - begins)[near]
            near, slot = near[ok], slot[ok]
            ok = same_bytes(data, begins[near], self.data, self.begins[slot], self.sizes[slot])
            out[near[ok]] = slot[ok]
        return out

    def add(self, hash_: np.ndarray, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> bool:
        """Gives the words the next slots in turn, unless the memo is full. Of words with one hash the first is found again."""
        if not len(hash_) or len(self.sizes) >= self.most:
            return False
        n = ends - begins
        slots = len(self.sizes) + np.arange(len(n))
        self.begins = np.concatenate([self.begins, len(self.data) + np.cumsum(n) - n])
        self.data, self.sizes = np.concatenate([self.data, data[spread(begins, n)]]), np.concatenate([self.sizes, n])
        both, slots = np.concatenate([self.hash, hash_]), np.concatenate([self.slot, slots])
        order = np.argsort(both, kind="stable")
        both, slots = both[order], slots[order]
        keep = np.append(True, both[1:] != both[:-1])
        self.hash, self.slot = both[keep], slots[keep]
        return True


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All of starts[i], ..., starts[i] + lengths[i] - 1, one i after the other."""
    starts, lengths = starts[lengths > 0], lengths[lengths > 0]
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(ends):
        out[0] = starts[0]
        out[ends[:-1]] = starts[1:] - starts[:-1] - lengths[:-1] + 1
        np.cumsum(out, out=out)
    return out


def shingles(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct runs of ``size`` words, ascending, and the n + 1 places where rows begin.

    A row of fewer words, but not none, has its whole sequence as the one run.
    """
    n = np.diff(first)
    total = np.zeros(len(word), np.uint64)
    for k in range(size):
        part = mix(word + np.uint64((k + 1) * 0x632BE59BD9B4E019 % 2**64))
        total[: max(0, len(word) - k)] += part[k:]
    total = mix(total)
    for i in np.flatnonzero((n > 0) & (n < size)):
        whole = word[first[i] : first[i + 1]]
        total[first[i]] = mix(np.array([int(n[i])], np.uint64) + (mix(whole + np.arange(1, len(whole) + 1, dtype=np.uint64))).sum(dtype=np.uint64))[0]
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    flat = total[spread(first[:-1], count)]
    place = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(place[:-1], place[1:], strict=True):
        flat[a:b].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[place[:-1][count > 0]] = True
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[place]

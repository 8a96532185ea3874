"""Hashes and memos of words, and words that polynomial hashes confuse, through the operators."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumiquarry.llm import decontaminate, maxent_lm, ngram_join, textbytes
from tests.llm.conftest import thue_morse


def words():
    rng = np.random.default_rng(1)
    return ["".join(rng.choice(list("ab"), rng.integers(0, 12))) for _ in range(400)] + ["x" * 300, "x" * 300, "x" * 299 + "y", *thue_morse()]


def test_hashes_tell_words_apart():
    own = sorted({*words(), "ab\0", "a", "ä", "x" * 256, "x" * 257})
    data, offsets = textbytes.utf8(pa.array(own))
    assert len(set(textbytes.hashes(data, offsets[:-1], offsets[1:]).tolist())) == len(own)


@pytest.mark.parametrize("kinds", [None, 1, 3])
def test_distinct_words_and_memo(monkeypatch, kinds):
    real = textbytes.hashes
    if kinds:
        monkeypatch.setattr(textbytes, "hashes", lambda d, b, e: real(d, b, e) % np.uint64(kinds))
    own = words()
    data, offsets = textbytes.utf8(pa.array(own))
    hash_, where, inverse = textbytes.distinct(data, offsets[:-1], offsets[1:])
    assert len(hash_) == len(set(own)) and all(own[where[k]] == w for k, w in zip(inverse, own, strict=True))
    memo = textbytes.Memo(10_000)
    begins, ends = offsets[where], offsets[where + 1]
    assert (memo.find(hash_, data, begins, ends) < 0).all() and memo.add(hash_, data, begins, ends)
    found = memo.find(hash_, data, begins, ends)
    assert all(f in (-1, k) for k, f in enumerate(found)) and (found >= 0).sum() == len(set(hash_.tolist()))


def test_operators_tell_such_words_apart(spark):
    w = thue_morse()
    docs = spark.createDataFrame(list(enumerate(w)), "doc_id long, text string").repartition(2)
    assert {r["doc_id"]: (r["component_id"], r["n_links"]) for r in ngram_join.jaccard_components(docs).collect()} == {k: (k, 0) for k in range(len(w))}
    found = decontaminate.benchmark_overlap(docs, spark.createDataFrame([(1, w[1])], "item_id long, text string"))
    assert [r["doc_id"] for r in found.where("n_hit > 0").collect()] == [1]
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1][:2]
    learned = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 != 1][:1]
    rows = [(learned[0], w[1]), (held[0], w[0]), (held[1], w[1])]
    out = {r["doc_id"]: r["n_known"] for r in maxent_lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {learned[0]: 2, held[0]: 1, held[1]: 2}

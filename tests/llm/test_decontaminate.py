import random
import re
from collections import Counter

import numpy as np

from lumiquarry.llm import decontaminate as dc

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = Counter()
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in wins:
                    hit |= set(range(k, k + size))
                    own |= wins[x]
        out[(d, len(w), len(hit), tuple(sorted(own)))] += 1
    return out


def got(df):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect())


def sample():
    r = random.Random(2)
    vocabulary = ["a", "b", "c", "Été", "x9"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 4, 9, 10, 11, 30])))) for k in range(2, 40)] + [(100, None), (None, "a b"), (101, "?!"), (7, "b b b b b b b b b b b")]
    docs = [(k, " ".join(r.choice(vocabulary + ["zz"] * 3) for _ in range(r.choice([0, 3, 20, 200])))) for k in range(80)]
    docs += [(900 + k, f"zz zz {t} zz, {t}") for k, t in items[:10]] + [(5, None), (5, docs[3][1])]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = sample()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [(i, t) for i, t in items if i is not None and t is not None])
    assert got(dc.benchmark_overlap(d, b)) == want
    assert got(dc.benchmark_overlap(d, b, block_bytes=60)) == want  # block by block
    monkeypatch.setattr(dc, "SHARD_BYTES", 200)
    assert got(dc.benchmark_overlap(d, b)) == want


def test_suffix_array_is_sorted():
    r = np.random.default_rng(0)
    for top in (1, 3, 2**40):
        ids = r.integers(0, top + 1, 400)
        ids[200:300] = ids[:100]
        order = dc.suffix_array(ids, 12)
        keys = [tuple(ids[k : k + 12]) for k in order]
        assert keys == sorted(keys) and sorted(order) == list(range(400))


def test_longest_match(spark):
    d = spark.createDataFrame([(1, "q q " + " ".join(f"w{k}" for k in range(3, 28)) + " q")], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(40)))], "item_id long, text string")
    r = dc.benchmark_overlap(d, b).first()
    assert (r["n_hit"], r["longest_match"], r["match_at"]) == (25, 25, 2)


def brute_longest(docs, items, window=10):
    """(longest, at): the longest verbatim stretch that begins with a window, by trying all places of all items."""
    out = {}
    for d, t in docs:
        w, best = words(t), (0, -1)
        for p in range(len(w)):
            for _, x in items:
                b = words(x)
                for q in range(len(b)):
                    k = 0
                    while p + k < len(w) and q + k < len(b) and w[p + k] == b[q + k]:
                        k += 1
                    full = k >= window or (q == 0 and k == len(b) < window)
                    opens = full or any(w[p : p + len(words(y))] == words(y) for _, y in items if 0 < len(words(y)) < window)
                    if opens and k > best[0]:
                        best = (k, p)
        out[d] = best
    return out


def longest(df):
    return {r["doc_id"]: (r["longest_match"], r["match_at"]) for r in df.collect()}


def test_longest_matches_are_of_one_item(spark):
    item = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    two = frame([(1, item(0, 11)), (2, item(1, 12))], "item_id")
    assert longest(dc.benchmark_overlap(frame([(1, item(0, 12))], "doc_id"), two)) == {1: (11, 0)}
    inside = frame([(1, item(0, 30)), (2, "w5 w6 w7")], "item_id")
    assert longest(dc.benchmark_overlap(frame([(1, item(0, 25))], "doc_id"), inside)) == {1: (25, 0)}
    r = random.Random(5)
    items = [(k, " ".join(r.choice("ab") for _ in range(r.choice([3, 8, 12, 25])))) for k in range(6)]
    docs = [(k, " ".join(r.choice("abz" if k % 2 else "ab") for _ in range(60)) + " " + items[k % 6][1]) for k in range(12)]
    want = brute_longest(docs, items, 7)
    for more in ({}, {"block_bytes": 20}):
        assert longest(dc.benchmark_overlap(frame(docs, "doc_id"), frame(items, "item_id"), window=7, **more)) == want


def test_edges(spark, edge_docs, no_docs):
    b = spark.createDataFrame([(1, "a b c d e f g h"), (2, None)], "item_id long, text string")
    out = dc.benchmark_overlap(edge_docs, b).collect()
    assert len(out) == edge_docs.count() and sum(r["n_hit"] > 0 for r in out) == 5
    kept = dc.remove_contaminated(edge_docs, b)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 5
    assert dc.benchmark_overlap(no_docs, b).count() == 0
    assert dc.remove_contaminated(edge_docs, b.limit(0)).count() == edge_docs.count()

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumiquarry.llm import maxent_lm as lm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs):
    own = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None]) for i, t in docs]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in own]
    c = Counter(w for (_, ws), h in zip(own, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (i, ws), h in zip(own, held, strict=True)]


def rows(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df.collect()), key=repr)


def test_base_against_brute_force(spark, copies, monkeypatch):
    for top in (lm.TOP, 30):  # with few words broadcast, the others' counts come by the shuffle
        monkeypatch.setattr(lm, "TOP", top)
        out = lm.scored(spark.createDataFrame(copies, "doc_id long, text string").repartition(4))
        assert rows(out) == sorted(brute(copies), key=repr)
        assert all(r["score"] < 0 for r in out.collect())


def test_scores_do_not_depend_on_what_is_broadcast_but_for_classes(spark):
    docs = [(k, "a b a b c " * (k % 4 + 1)) for k in range(60)]
    out = {r["doc_id"]: r for r in lm.scored(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(r["score"] for r in out.values() if r["held_out"]) > sum(r["base_score"] for r in out.values() if r["held_out"])


def test_the_model_is_a_distribution():
    """Class and slot probabilities sum to one, and so do the words' shares of each slot, with an unknown word in those of the last class."""
    r = np.random.default_rng(1)
    top = [(int(h), int(c)) for h, c in zip(r.integers(-(2**62), 2**62, 900), r.integers(1, 900, 900), strict=True)]
    rare = r.integers(-(2**62), 2**62, 25).view(np.uint64)
    every, count = np.concatenate([np.array([h for h, _ in top]).view(np.uint64), rare]), np.array([c for _, c in top] + [2] * 25)
    slots = np.stack([np.bincount(lm.Words.hashed(every), count, lm.WIDTH), np.bincount(lm.Words.hashed(every), minlength=lm.WIDTH)])
    w = lm.Words(top, int(count.sum()), 925, slots)
    for bias, wide in ((w.bias, lm.CLASSES), (w.slot_bias[r.integers(0, lm.CLASSES, 50)], lm.WIDTH)):
        p = lm.softmax(r.normal(size=(1 << 12, wide)).astype(np.float32), bias, r.integers(0, 1 << 12, (lm.FEATURES, 50)))
        assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    for k in range(lm.CLASSES - 1):
        for s in range(lm.WIDTH):
            own = (w.kind == k) & (w.slot == s)
            assert np.isclose(w.mass[k, s], (w.count[own] + 0.5).sum())
            assert w.mass[k, s] > 0 or w.slot_bias[k, s] == -np.inf
    assert np.allclose(w.mass[-1], 2.5 * np.bincount(lm.Words.hashed(rare), minlength=lm.WIDTH) + 0.5)


def test_row_sums_against_a_loop():
    """Groups of one row, of as many as are added at a time, and of more; whole numbers, so that sums are exact."""
    r = np.random.default_rng(2)
    sizes = [1, 1, 2, lm.DEEP - 1, lm.DEEP, lm.DEEP + 1, 5, 300, 1]
    for key in (r.permutation(np.repeat([9, 0, 4, 65535, 7, 3, 2, 1, 500], sizes)), np.array([6]), np.zeros(40, int), np.arange(70)):
        key = key.astype(np.uint16)
        g = r.integers(-9, 9, (len(key), lm.WIDTH)).astype(np.float32)
        keys, sums, n = lm.row_sums(g, key)
        assert sorted(keys.tolist()) == sorted(set(key.tolist()))
        for k, total, count in zip(keys, sums, n, strict=True):
            assert count == (key == k).sum() and (total == g[key == k].sum(axis=0)).all()


def test_words_are_found_among_others_of_like_hashes():
    """Against a dictionary: crowded leading bits, hashes beside the words', the least and the largest."""
    r = np.random.default_rng(4)
    near = (1 << 40) + np.arange(0, 600, 2)
    far = r.integers(-(2**63), 2**63 - 1, 400)
    every = np.unique(np.concatenate([near, far, [0, -1]])).astype(np.int64)  # -1 is the largest without a sign
    for held in (every, every[:1], near.astype(np.int64), every[every != -1]):
        w = lm.Words([(int(h), k + 1) for k, h in enumerate(held)], 10, len(held), np.zeros((2, lm.WIDTH), np.int64))
        asked = np.concatenate([every, near + 1, r.integers(-(2**63), 2**63 - 1, 400)]).astype(np.int64)
        count = {int(h): k + 1 for k, h in enumerate(held)}
        assert w.look(asked.view(np.uint64))[2].tolist() == [count.get(int(h), -1) for h in asked]


def test_learning_costs_few_scorings():
    """Summing gradients by row took nearly all of the query's CPU; a learning step cost some six scoring ones, and costs three."""
    r = np.random.default_rng(5)
    token = lm.mix(r.integers(0, 4000, 20 * lm.STEP).astype(np.uint64))
    h, c = np.unique(token, return_counts=True)
    slots = np.stack([np.bincount(lm.Words.hashed(h), c, lm.WIDTH), np.bincount(lm.Words.hashed(h), minlength=lm.WIDTH)])
    w = lm.Words(list(zip(h.view(np.int64).tolist(), c.tolist(), strict=True)), len(token), len(h), slots)
    kind, slot, _ = w.look(token)
    feature = lm.contexts(token, np.array([0, len(token)]))
    model = lm.Model(lm.INNER, lm.STEP).begin()

    def seconds(learn):
        began = time.process_time()
        model.steps(w, feature, kind, slot, learn=learn)
        return time.process_time() - began

    took = [(seconds(True), seconds(False)) for _ in range(6)]
    assert min(a for a, _ in took) < 4.5 * min(b for _, b in took)


def brute_scores(docs, step):
    """The model's scores of one task's rows, learned from dictionaries a token at a time; feature rows and slots are the operator's."""
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs]
    own = [lm.tokens(pa.array([t])) for _, t in docs]
    count = Counter(h for (tok, _), out in zip(own, held, strict=True) if not out for h in tok.tolist())
    total, types = sum(count.values()), len(count)
    ranked = sorted(count, key=lambda h: (-count[h], h))
    place, mass = {}, Counter()
    for rank, h in enumerate(ranked):
        if rank < lm.SINGLE:
            place[h] = (rank, 0)
        else:
            assert rank < lm.SINGLE + lm.FULL * lm.WIDTH
            place[h] = (lm.SINGLE + (rank - lm.SINGLE) // lm.WIDTH, (rank - lm.SINGLE) % lm.WIDTH)
        mass[place[h]] += count[h] + 0.5
    last = lm.CLASSES - 1
    for s in range(lm.WIDTH):
        mass[(last, s)] += 0.5
    whole = Counter()
    for (k, _), m in mass.items():
        whole[k] += m
    all_ = sum(whole.values())
    tables = [{}, {}]
    past = [{}, {}]
    bits = max(10, total.bit_length() - 8)

    def spot(h):
        return place.get(h) or (last, int(lm.Words.hashed(np.array([h], np.uint64))[0]))

    def probabilities(which, rows, k):
        units = range(lm.CLASSES) if which == 0 else range(lm.WIDTH)
        prior = [whole[u] / all_ for u in units] if which == 0 else [mass[(k, u)] / whole[k] for u in units]
        z = [p * math.exp(sum(tables[which].get(r, [0.0] * len(prior))[u] for r in rows)) for u, p in zip(units, prior, strict=True)]
        return [x / sum(z) for x in z]

    def batch(feature, hashes_, learn):
        logs = []
        for which in (0, 1):
            grads, out = {}, []
            for n, h in enumerate(hashes_):
                k, s = spot(h)
                if which and k < lm.SINGLE:
                    out.append(0.0)
                    continue
                own = feature[:, n : n + 1]
                rows = [int(x[0]) for x in (lm.table_rows(own, bits, np.array([k])) if which else lm.table_rows(own, lm.BITS))]
                p = probabilities(which, rows, k)
                out.append(math.log10(p[s if which else k]))
                p[s if which else k] -= 1
                for f, r in enumerate(rows):
                    g = grads.setdefault((f, r), [0.0] * len(p))
                    for u, x in enumerate(p):
                        g[u] += x
            for (_, r), g in sorted(grads.items()) if learn else ():
                past[which][r] = past[which].get(r, 1e-2) + sum(x * x for x in g) / len(g)
                w = tables[which].setdefault(r, [0.0] * len(g))
                for u, x in enumerate(g):
                    w[u] -= lm.RATE * x / math.sqrt(past[which][r])
            logs.append(out)
        return [a + b for a, b in zip(*logs, strict=True)]

    learned = [t for (t, _), out in zip(own, held, strict=True) if not out]
    tok = np.concatenate(learned)
    feature = lm.contexts(tok, np.concatenate([[0], np.cumsum([len(t) for t in learned])]))
    for at in range(0, len(tok), step):
        batch(feature[:, at : at + step], tok[at : at + step].tolist(), True)
    out = {}
    for (i, _), (t, at) in zip(docs, own, strict=True):
        logs = batch(lm.contexts(t, at), t.tolist(), False)
        out[i] = sum(x + math.log10((count[h] + 0.5) / mass[spot(h)]) for x, h in zip(logs, t.tolist(), strict=True))
    return out


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEP", 64)
    r = random.Random(3)
    words = [f"w{k}" for k in range(90)]
    docs = [(k, " ".join(words[min(89, int(r.expovariate(0.06)))] for _ in range(r.choice([0, 5, 30]))) + " end " * (k % 3)) for k in range(40)]
    out = lm.scored(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    want = brute_scores(docs, 64)
    assert {r["doc_id"]: r["score"] for r in out.collect()} == pytest.approx(want, abs=2e-3, rel=1e-4)


def test_many_tasks_average_in_a_tree(spark, copies, monkeypatch):
    """More teams than one: the average of all tasks' rows by how often each met them, whatever the tree."""
    monkeypatch.setattr(lm, "FAN", 2)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(7)
    two = {r["doc_id"]: r["score"] for r in lm.scored(docs).collect()}
    monkeypatch.setattr(lm, "FAN", 16)
    assert {r["doc_id"]: r["score"] for r in lm.scored(docs).collect()} == pytest.approx(two, rel=1e-4)


def test_training_beats_the_base_on_held_out_rows(spark):
    out = lm.op6_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b").first()
    assert out["s"] > out["b"]


def test_edges(spark, edge_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()]
    assert rows(lm.scored(edge_docs)) == sorted(brute(docs), key=repr)
    assert lm.scored(no_docs).count() == 0
    held = [(k, "only held out") for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 1]
    assert rows(lm.scored(spark.createDataFrame(held, "doc_id long, text string"))) == sorted(brute(held), key=repr)


def test_without_training_texts_scores_are_finite(spark):
    held = [(k, "only held out") for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 1]
    out = lm.scored(spark.createDataFrame(held, "doc_id long, text string")).collect()
    assert all(math.isfinite(r["score"]) and r["train_tokens"] == 0 for r in out)


def test_parts_without_rows(spark):
    """With more parts than rows or words, parts that hold one kind of row alone still meet their like."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        docs = [(1, "alpha beta gamma delta " * 3), (2, "alpha x")]
        for own in (docs, docs[:1], [(k, t) for k, t in zip((11, 16), ("only held", "out"), strict=True)]):
            assert rows(lm.scored(spark.createDataFrame(own, "doc_id long, text string"))) == sorted(brute(own), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)

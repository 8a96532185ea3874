import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumiquarry.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_held_out_rows_are_told_apart(spark):
    out = q.op2_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    score, label = np.array([r["score"] for r in out]), np.array([r["quality"] for r in out])
    auc = (score[label == 1][:, None] > score[label == 0]).mean()
    assert auc > 0.95 and np.mean([r["predicted"] == r["quality"] for r in out]) > 0.95


def test_rows_of_the_query(spark):
    """A row for each document; held_out and predicted are what the contract says, counted in plain Python."""
    docs = [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()]
    out = q.op2_quality_classifier(spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out)


def plain_features(text):
    """How often each kind of feature comes, from Python's own words and characters."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return [words, list(zip(words[:-1], words[1:], strict=True)), [text[i : i + 3] for i in range(len(text) - 2)], [text[i : i + 4] for i in range(len(text) - 3)]]


def test_features_are_of_words_and_characters():
    texts = ["naïve Ärger Ärger", "", "ab", "你好世界 你好", "x x y", " \U0001f642\U0001f642a"]
    data, offsets = q.utf8(pa.array(texts))
    for kind, (bucket, place) in enumerate(q.features(data, offsets)):
        seen = {}
        for k, t in enumerate(texts):
            own, want = bucket[place[k] : place[k + 1]].tolist(), plain_features(t)[kind]
            assert len(own) == len(want)
            for b, f in zip(own, want, strict=True):
                f = "same" if kind == 1 and f[0] == f[1] else f
                assert seen.setdefault(f, b) == b
        assert len(set(seen.values())) >= len(seen) - 1
    assert q.features(data, offsets)[1][0][1] == 0  # a pair of equal words


def test_only_texts_and_training_labels_matter(spark):
    docs = spark.createDataFrame([(k, f"good words {k} here" if k % 2 else f"bad### text### {k}###") for k in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    one = q.fit(docs, labels)
    flipped = labels.selectExpr("doc_id", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0, 1 - quality, quality) as quality")
    two = q.fit(docs, flipped)
    assert (one[0] == two[0]).all() and one[1] == two[1]
    got = q.scored(docs, one).collect()
    assert all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in got)


def trained_with_vectors(rows, label, seed=7):
    """The same descent, step by step on dense means, keeping vectors and output layer apart."""
    share = (label.sum() + 0.5) / (len(label) + 1)
    bias = np.array([0.0, np.log(share / (1 - share))])
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / q.DIM, 1 / q.DIM, (1 << q.BITS, q.DIM)).astype(np.float32).astype(float)
    out = rng.uniform(-1, 1, (2, q.DIM)).astype(np.float32).astype(float)
    past, past_out, past_bias = 1e-6, 1e-4, 1e-2
    for _ in range(q.EPOCHS):
        for i in rng.permutation(len(rows)):
            bucket, part = rows[i]
            mean = sum(p * vectors[b] for b, p in zip(bucket, part, strict=True))
            e = np.exp(out @ mean + bias)
            off = e / e.sum() - np.eye(2)[int(label[i])]
            step = np.outer(part, off @ out)
            past += (step**2).sum()
            grad = np.outer(off, mean)
            vectors[bucket] -= q.RATE * step / np.sqrt(past)
            past_out += (grad**2).mean()
            out -= q.RATE / 10 * grad / np.sqrt(past_out)
            past_bias += (off**2).mean()
            bias -= q.RATE / 10 * off / np.sqrt(past_bias)
    return vectors, out, bias


def test_the_fold_equals_scoring_with_vectors():
    """What a bucket adds to the logit is its vector in the output layer: the softmax over the mean of vectors gives the same."""
    r = np.random.default_rng(0)
    rows = [np.unique(r.integers(0, 50, 9)).astype(np.uint32) for _ in range(60)]
    rows = [(b, np.full(len(b), 1 / len(b), np.float32)) for b in rows]
    label = np.array([int(b.min() < 5) for b, _ in rows])
    w, bias = q.train(rows, label)
    vectors, out, two = trained_with_vectors(rows, label)
    for b, p in rows:
        e = np.exp(out @ (p @ vectors[b]) + two)
        assert 1 / (1 + np.exp(-(w[b] @ p + bias))) == pytest.approx(e[1] / e.sum(), abs=2e-3)
    assert np.mean([(w[b] @ p + bias > 0) == y for (b, p), y in zip(rows, label, strict=True)]) > 0.8


def test_scores_are_the_mean_weight_of_all_features(spark):
    """Against each feature of each text looked up by itself."""
    texts = ["good words here", "", "bad### text###", "a", "naïve 🙂 Ärger Ärger", "one two " * 500, None]
    docs = spark.createDataFrame([(k, t, 9.0) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    weights, bias = np.random.default_rng(3).normal(size=1 << q.BITS).astype(np.float32), 0.25
    got = {r["doc_id"]: r["score"] for r in q.scored(docs, (weights, bias)).collect()}
    for k, t in enumerate(texts):
        data, offsets = q.utf8(pa.array([t or ""]))
        own = [float(weights[b]) for bucket, _ in q.features(data, offsets) for b in bucket]
        assert len(own) == sum(len(x) for x in plain_features(t or ""))
        z = (sum(own) / len(own) if own else 0.0) + bias
        assert got[k] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 1), (6, 0), (6, 0)], "doc_id long, quality int")
    model = q.fit(edge_docs, labels)
    out = q.scored(edge_docs, model)
    assert out.count() == edge_docs.count() and sorted(out.columns) == sorted(edge_docs.columns)
    scores = {r["text"]: r["score"] for r in out.collect()}
    assert scores[None] == pytest.approx(scores[""]) and all(0 <= s <= 1 for s in scores.values())
    none = q.fit(edge_docs, labels.limit(0))
    assert {r["score"] for r in q.scored(edge_docs, none).collect()} == {0.5}
    assert q.scored(no_docs, model).count() == 0

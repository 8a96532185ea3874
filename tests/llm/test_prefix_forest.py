import numpy as np

from lumiquarry.llm import prefix_forest as pf

SCHEMA = "vec_id long, embedding array<float>, id int, v int, score int"


def brute(vectors, queries, k):
    out = {}
    for q, x in queries.items():
        near = sorted(((-float((np.asarray(x) * np.asarray(y)).sum()), i) for i, y in vectors.items() if i != q))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_small_sets_are_exact(spark):
    r = np.random.default_rng(4)
    vectors = {k: r.normal(size=8).astype(np.float32).astype(float) * (1 + k % 3) for k in range(150)}
    for k in range(100, 130):
        vectors[k] = vectors[100]  # ties go to the smaller id
    bad = [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0] * 7 + [None]), (504, [float("nan")] * 8), (505, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (506, [1.0] * 5)]
    df = spark.createDataFrame([(k, v.tolist(), 1, 2, 3) for k, v in vectors.items()] + [(k, v, 1, 2, 3) for k, v in bad] + [(3, vectors[3].tolist(), 0, 0, 0)], SCHEMA).repartition(4)
    got = {}
    for row in pf.nearest_neighbours(df, df.where("vec_id % 10 = 0 or vec_id > 499"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    want = brute(vectors, {k: v for k, v in vectors.items() if k % 10 == 0}, 20)
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]]) for q in want)


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    queries = {k: v for k, v in vectors.items() if k % 20 == 0}
    want = brute(vectors, queries, 20)
    got = {}
    for r in pf.nearest_neighbours(rows, rows.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in queries]) >= 0.9


def test_blocks_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(pf, "QUERIES", 3)
    monkeypatch.setattr(pf, "SHARD", 4)
    df = spark.createDataFrame([(k, [float(k), 1.0], 0, 0, 0) for k in range(1, 12)], SCHEMA)
    out = pf.nearest_neighbours(df, df, k=20).collect()
    assert len(out) == 11 * 10 and all(r["rank"] <= 10 for r in out)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pf.nearest_neighbours(none, none).count() == 0
    some = spark.createDataFrame([(1, [1.0], 0, 0, 0), (2, [2.0], 0, 0, 0)], SCHEMA)
    assert pf.nearest_neighbours(some, none).count() == 0


def test_other_shards_end_the_ascent(monkeypatch):
    """A shard without near rows is left early where another has them."""
    r = np.random.default_rng(6)
    v, q = r.normal(size=(2000, 32)), r.normal(size=(40, 32))
    hashed = pf.strings(np.concatenate([pf.unit(q), np.zeros((40, 1))], axis=1), pf.planes(32)).T.copy()
    forest, seen, real = pf.Forest(np.arange(2000), v), [], pf.Forest.ranges
    monkeypatch.setattr(pf.Forest, "ranges", lambda self, h, level: seen.append(int(level.min())) or real(self, h, level))
    alone = list(forest.nearest(np.arange(9000, 9040), q, hashed, 20, np.full(40, -np.inf)))
    deep = seen[-1]  # the last level that any query reached
    seen.clear()
    list(forest.nearest(np.arange(9000, 9040), q, hashed, 20, np.full(40, 0.95 * (pf.length(q) * pf.length(v).max()).min())))
    assert seen[-1] > deep and all(len(i) == 20 for i, _ in alone)


def forest_recall(v, queries=60, k=20):
    """Recall of the k nearest within one shard, and the share of the shard that a query's candidates were."""
    ids = np.arange(len(v))
    forest = pf.Forest(ids, v)
    hashed = pf.strings(np.concatenate([pf.unit(v[:queries]), np.zeros((queries, 1))], axis=1), pf.planes(v.shape[1])).T.copy()
    score = v[:queries] @ v.T
    score[np.arange(queries), np.arange(queries)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :k]
    probe = forest.nearest(ids[:queries], v[:queries], hashed, k)
    floor = np.array([s[k - 1] if len(s) == k else -np.inf for _, s in probe])
    got = forest.nearest(ids[:queries], v[:queries], hashed, k, floor)
    return np.mean([len(set(i) & set(w)) / k for (i, _), w in zip(got, want, strict=True)])


def test_recall_of_full_shards_whatever_the_data(monkeypatch):
    r = np.random.default_rng(2)
    centres = r.normal(size=(200, 32))
    near = centres[r.integers(0, 200, pf.SHARD)] + 0.3 * r.normal(size=(pf.SHARD, 32))
    lowest, real = [], pf.Forest.ranges
    monkeypatch.setattr(pf.Forest, "ranges", lambda self, h, level: lowest.append(int(level.min())) or real(self, h, level))
    for v, least in ((r.normal(size=(pf.SHARD, 16)), 1), (near, 6), (near * np.exp(0.3 * r.normal(size=(pf.SHARD, 1))), 1), (near * 1e100, 6)):
        lowest.clear()
        assert forest_recall(v) >= 0.9
        assert lowest[-1] >= least  # near neighbours end the ascent early: the hardest query under 1/64 of each tree

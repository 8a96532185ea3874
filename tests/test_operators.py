"""Operators against plain Python on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiquarry.operators import aggregate, cluster, density, islands, joins, mutate, rank
from lumiquarry.operators.graph import connected_components
from lumiquarry.plans import curate, dedup, moments, search, stories, taste


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 160)] + [(5, 5), (None, 3)]
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            ra = next(iter([root.setdefault(a, {a})]))
            rb = root.setdefault(b, {b})
            both = ra | rb
            for x in both:
                root[x] = both
    want = {x: min(s) for x, s in root.items()}
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_hubs_stay_where_they_are(spark):
    """Three quarters of the rows have one key: it is broadcast, and no task of the shuffled join reads over its share."""
    rows = spark.range(8000).select(F.when(F.col("id") % 4 < 3, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    sums = rows.groupBy("k").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    got = joins.hub_join(rows, sums, "k", "n", 8000)
    assert got.columns == ["k", "v", "m"]
    assert got.count() == 8000 and got.where("m = 0").count() == 6000 and got.where("k <> -1 and m <> v").count() == 0
    assert sums.where(f"n > {8000 // int(spark.conf.get('spark.sql.shuffle.partitions'))}").count() == 1
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    star = spark.range(1, 3000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).union(spark.range(3000, 3100).select(F.col("id"), F.lit(9999).cast("long")))
    out = connected_components(star)
    assert out.where("component = 0").count() == 3000 and out.where("component = 3000").count() == 101 and out.count() == 3101


def test_band_and_intervals(spark):
    r = random.Random(2)
    t = [(k, r.choice([0.0, 5.0, 12.0, 12.5]) + 12 * r.randrange(40)) for k in range(200)]
    got = {(x["k_a"], x["k_b"]) for x in joins.band_pairs(spark.createDataFrame(t, "k long, at double"), "at", "k", 12).collect()}
    assert got == {(a, b) for a, x in t for b, y in t if 0 <= y - x <= 12 and (y > x or a < b)}
    spans = [(k, x, x + r.choice([0.0, 3.0, 90.0])) for k, x in t[:60]] + [(999, 5.0, 1.0)]
    found = joins.in_interval(spark.createDataFrame(t, "k long, at double"), spark.createDataFrame(spans, "s long, b double, e double"), "at", "b", "e", 20)
    assert {(x["k"], x["s"]) for x in found.collect()} == {(k, s) for k, x in t for s, b, e in spans if b <= x <= e}


def test_range_scores_scenes_and_sessions(spark):
    rows = [("d", 0.0, None, None, 1), ("d", 100.0, 34.0, 77.0, 2), ("d", 6000.0, 34.0, 77.0, 3), ("d", 6001.0, 34.1, 77.0, 4), ("d", None, 34.1, 77.0, 5)]
    df = spark.createDataFrame(rows, "day string, at double, lat double, lon double, id int")
    assert [x["block"] for x in islands.sessions(df, ["day"], "at", "lat", "lon", "id").orderBy("id").collect()] == [0, 0, 1, 2, 2]
    v = spark.createDataFrame([(1, 0.0, [1.0, 0.0], 0), (1, 700.0, [1.0, 0.0], 1), (1, 750.0, [0.0, 1.0], 2), (1, 1500.0, [1.0, 0.0], 3)], "g int, at double, v array<double>, id int")
    assert [x["scene"] for x in islands.scenes(v, ["g"], "at", "v", "id").orderBy("id").collect()] == [0, 0, 0, 1]
    good = [True, True, True, False, False, True, False, False, True, True]
    f = spark.createDataFrame([(1, float(k), g) for k, g in enumerate(good)], "v int, at double, good boolean")
    assert sorted((x["start"], x["end"], x["frames"]) for x in islands.good_runs(f, ["v"], "at", "good").collect()) == [(0, 2, 3), (8, 9, 2)]


def test_ranks(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([3.0, 1.0, 1.0, 2.0, None])], "k int, v double")
    got = {x["k"]: x["r"] for x in df.where("v is not null").select("k", rank.average_rank("v").alias("r")).collect()}
    assert got == {0: 3.0, 1: 0.5, 2: 0.5, 3: 2.0}
    assert [x["r"] for x in rank.global_rank(spark.range(1000).withColumn("v", F.col("id") * 7 % 1000), [F.col("v")], "r").orderBy("v").collect()] == list(range(1000))
    assert df.agg(rank.nearest_rank(F.col("v"), 50).alias("x"), rank.upper_median(F.col("v")).alias("m")).first() == (1.0, 2.0)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "a double, b double")
    assert flat.agg(aggregate.pearson(F.col("a"), F.col("b")).alias("c")).first()["c"] == 0
    far = spark.range(1, 200).select((1e9 + F.col("id") / 1000).alias("a"), (1e9 + 2 * F.col("id") / 1000).alias("b"))
    assert far.agg(aggregate.pearson(F.col("a"), F.col("b")).alias("c")).first()["c"] == pytest.approx(1, abs=1e-6)
    values = [5.0, 1.0, 1.0, None, 9.0, 2.5]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for p in (0, 10, 25, 50, 75, 100):
        assert rank.whole_percentile(frame, F.col("v"), p).first()[0] == pytest.approx(np.percentile([v for v in values if v is not None], p))
    assert rank.whole_percentile(frame.where("v is null"), F.col("v"), 50).first()[0] is None
    assert aggregate.rank_auc(spark.createDataFrame([(1, 2.0), (0, 1.0), (0, 2.0)], "y int, s double"), F.col("y") == 1, "s").first()["auc"] == 0.75
    assert aggregate.rank_auc(spark.createDataFrame([(1, 2.0)], "y int, s double"), F.col("y") == 1, "s").first()["auc"] is None


def test_curation_rules(spark):
    schema = "photo_id long, day string, ap25 double, nima double"
    rows = [(1, "a", 7.0, 7.0), (2, "a", 6.9, 6.9), (3, "b", 8.0, 8.0), (4, "b", 6.5, 6.5), (5, "c", None, 9.0), (6, "d", 1.0, 1.0)]
    p = spark.createDataFrame(rows, schema)
    stacks = spark.createDataFrame([(1, 10, 99), (2, 10, 99), (3, 11, 99), (4, 11, 99)], "photo_id long, moment_id long, primary_photo_id long")
    shut = spark.createDataFrame([(1, 0.3), (3, 0.3)], "photo_id long, penalty double")
    got = curate.curate(p, p, by=["day"], moments=stacks, penalties=shut, percent=0)
    assert {x["photo_id"] for x in got.collect()} == {2, 3, 6}
    # The library's floor never empties a scope that has scored photos.
    assert {x["photo_id"] for x in curate.curate(p, p, by=["day"], percent=75, library_percent=90).collect()} == {1, 3, 6}
    assert {x["photo_id"] for x in curate.curate(p, p, percent=50).collect()} == {1, 2, 3}
    liked = spark.createDataFrame([(6, 1.0), (3, 0.0)], "photo_id long, taste double")
    final = {x["photo_id"]: x["final"] for x in curate.curate(p, p, percent=0, taste=liked, taste_samples=1000).collect()}
    assert final[6] == pytest.approx(0.4) and final[3] == pytest.approx(0.6) and all(0 <= f <= 1 for f in final.values())


def test_hybrid_search(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.4, 0.9]), (4, None)], "photo_id long, embedding array<double>")
    tags = spark.createDataFrame([(3, "monastery"), (4, "monastery")], "photo_id long, tag string")
    got = search.hybrid(e, tags, ["monastery"], [1.0, 0.0]).orderBy(F.desc("score")).collect()
    assert [x["photo_id"] for x in got] == [3, 1, 2] and got[0]["score"] > 10
    assert search.restricted(e, None, tags.where("false")).count() == 0 and search.restricted(e, None).count() == 4


def test_duplicates(spark):
    rows = [("s1", "x", 0.4, 10, 1, [1.0, 0.0, 0.0, 0.0]), ("s2", "y", 0.6, 20, 2, [0.999, 0.001, 0.0, 0.0]), ("s3", "z", 0.9, 30, 3, [0.0, 1.0, 0.0, 0.0]), ("s4", "w", 0.5, 100, 4, [0.0, 0.0, 1.0, 0.0]), ("s5", "w", 0.9, 200, 5, [0.0, 0.0, 1.0, 0.0])]
    p = spark.createDataFrame(rows, "name string, sha256 string, iqa double, size_bytes long, photo_id long, embedding array<double>")
    assert [tuple(x) for x in aggregate.exact_duplicates(p, "sha256", "photo_id", F.col("iqa"), F.col("size_bytes")).collect()] == [("w", 2, 5, 100)]
    report = {x["kind"]: (x["groups"], x["photos"], x["reclaimable"]) for x in dedup.report(p).collect()}
    assert report == {"exact": (1, 2, 100), "near": (1, 2, 10)}
    assert dedup.near_pairs(p, most=3).count() == 0 and dedup.near_pairs(p, most=None, block=2).count() == 2


def test_bursts(spark):
    s = "photo_id long, at double, lat double, lon double, v array<double>, faces array<array<double>>, iqa double, blur double"
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 0.0, 34.0, 77.0, v, [], 0.1, 1.0), (2, 12.0, 34.0001, 77.0001, v, [], 0.9, 1.0), (3, 25.1, 34.0, 77.0, v, [], 0.5, 1.0), (4, 100.0, None, None, v, [v], 0.1, 1.0), (5, 101.0, 34.0, 77.0, v, [w], 0.1, 1.0), (6, 102.0, 10.0, 1.0, v, [w, v], 0.1, 1.0), (7, 200.0, None, None, v, [], 0.1, 1.0), (8, 201.0, None, None, w, [], 0.1, 1.0)]
    p = spark.createDataFrame(rows, s)
    edges = moments.burst_edges(p)
    assert {(x["a"], x["b"]) for x in edges.collect()} == {(1, 2), (4, 6)}
    m = moments.burst_moments(moments.burst_members(p, edges))
    assert {(x["moment_id"], x["primary_photo_id"], x["size"]) for x in m.collect()} == {(1, 2, 2), (4, 4, 2)}


def test_linkage_keeps_the_farthest_members_near():
    r = np.random.default_rng(2)
    v = r.normal(size=(40, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = cluster.complete_linkage(v.copy(), 0.55)
    d = 1 - v @ v.T
    for c in np.unique(label):
        own = np.flatnonzero(label == c)
        assert d[np.ix_(own, own)].max() <= 0.55 + 1e-9
    tops = np.unique(label)
    assert all(d[np.ix_(label == a, label == b)].max() > 0.55 for a in tops for b in tops if a < b)


def test_persons_and_representatives(spark):
    r = np.random.default_rng(3)
    rows = [(10 * p + k, 100 * p + k, (np.eye(6)[p] + 0.05 * r.normal(size=6)).tolist()) for p in range(3) for k in range(4)] + [(99, 99, np.eye(6)[5].tolist())]
    df = spark.createDataFrame(rows, "face_id long, photo_id long, embedding array<double>")
    got = {x["face_id"]: x["person"] for x in cluster.persons(df).collect()}
    assert got == {10 * p + k: 10 * p for p in range(3) for k in range(4)}
    scene = spark.createDataFrame([(1, k, np.eye(10)[k].tolist(), q, 100.0, 100.0, 0.0) for k, q in enumerate([0.3, 0.9, 0.2, 0.4, 0.4, 0.4, 0.4])], "scene int, photo_id long, v array<double>, iqa double, blur double, p95 double, face double")
    out = cluster.representatives(scene, ["scene"]).orderBy("pick").collect()
    assert len(out) == 2 and out[0]["photo_id"] == 1
    alike = scene.withColumn("v", F.array(F.lit(1.0), F.lit(0.0)))
    assert cluster.representatives(alike, ["scene"]).count() == 1


def test_density_clusters():
    r = np.random.default_rng(4)
    v = np.concatenate([np.eye(8)[c] + 0.02 * r.normal(size=(30, 8)) for c in range(3)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = density.density_tree(v, 5)
    assert [len(set(label[30 * c : 30 * c + 30]) - {-1}) for c in range(3)] == [1, 1, 1] and len(set(label) - {-1}) == 3
    assert (density.density_tree(v[:6], 5) == 0).all()


def test_names_of_clusters(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 5), (1, [1.0, 0.1], 9), (2, [1.0, 0.0], 1)], "cluster long, centroid array<double>, n long")
    got = density.cluster_names(rows, {"sea": [1, 0], "sky": [0, 1]}).collect()
    assert {r["cluster"]: r["name"] for r in got} == {1: "sea", 0: "sky", 2: "sea 2"}


def test_places(spark):
    rows = [(1, "Leh", 34.0, 77.0, 1), (2, "Leh (2)", 34.1, 77.0, 2), (3, "Leh", 34.001, 77.0, 3), (4, "Nubra", 34.0, 77.0, 4)]
    got = {x["visit_id"]: x["name"] for x in cluster.numbered_places(spark.createDataFrame(rows, "visit_id long, name string, lat double, lon double, arrived_at int")).collect()}
    assert got == {1: "Leh", 2: "Leh (2)", 3: "Leh", 4: "Nubra"}
    few = [("A Tso", 34.0, 77.0, 0), ("B", 34.01, 77.0, 9), ("C", 35.0, 77.0, None), ("D", None, 77.0, 1)]
    schema = "name string, lat double, lon double, photos long"
    assert {x["name"]: x["merged"] for x in cluster.merged_names(spark.createDataFrame(few, schema)).collect()} == {"A Tso": "A Tso", "B": "A Tso", "C": "C", "D": "D"}
    r = random.Random(7)
    many = [(f"P{k:02d}" + r.choice(["", "", " Valley"]), r.choice([0.0, 34.0, -71.0]) + r.uniform(0, 0.25), 77 + r.uniform(0, 0.25), r.randrange(4)) for k in range(60)]
    to = {}
    for a, alat, alon, an in sorted(many):  # every pair in the order of names; a name that has lost is out
        for b, blat, blon, bn in sorted(many):
            km = 111.0 * np.hypot(alat - blat, (alon - blon) * np.cos(np.radians((alat + blat) / 2)))
            if a < b and a not in to and b not in to and km <= 5:
                first = (" Valley" in a, an, len(a)) >= (" Valley" in b, bn, len(b))
                to[b if first else a] = a if first else b
    got = {x["name"]: x["merged"] for x in cluster.merged_names(spark.createDataFrame(many, schema)).collect()}
    assert got == {n: to.get(n, n) for n, *_ in many} and len(to) > 10


def test_mutations(spark):
    links = spark.createDataFrame([(1, 5, 50, 0.9), (1, 7, 70, 0.9), (2, 7, 71, 0.8), (3, 8, 80, 0.1)], "photo_id long, person_id long, face_embedding_id long, confidence double")
    merged, counts = mutate.merged_persons(links, [7], 5)
    assert {(x["photo_id"], x["person_id"], x["face_embedding_id"]) for x in merged.collect()} == {(1, 5, 50), (2, 5, 71), (3, 8, 80)}
    assert {x["person_id"]: x["photo_count"] for x in counts.collect()} == {5: 2, 8: 1}
    null = spark.createDataFrame([(1, "t", None)], "photo_id long, tag string, source string")
    assert mutate.inserted_if_absent(null, null, ["photo_id", "tag", "source"]).count() == 2  # null sources never meet


def test_stories(spark):
    request = stories.parse("Best photos of me and Alice at Leh, golden hour top 5", [(4, "Alice"), (9, None)], ["Leh", "Nubra"], ["hot"])
    assert request.persons == [4] and request.places == ["Leh"] and request.hour == "golden hour" and request.best and request.most == 5 and request.tags == ["hot"] * ("hot" in "photos")
    assert stories.parse("rooftop with us", [(4, None), (9, None), (2, None)], [], []).persons == [4, 9]
    said = ["p9 and P4 near NUBRA", "candid", "me together", "i", None, "stop me", "top 99 sunset then morning", "TOP  7 favourites", "top 0", "top 123", "p44", "rooftop"]
    got = stories.requests(spark.createDataFrame([(x,) for x in said], "sentence string"), [(4, "Alice"), (9, "")], ["Leh", "Nubra", ""], []).drop("places", "tags").collect()
    want = [([4, 9], None, 0.0, False, 24), ([], None, 0.1, False, 24), ([4], None, 0.0, False, 24), ([4], None, 0.0, False, 24), ([], None, 0.0, False, 24), ([4], None, 0.3, True, 24), ([], "sunset", 0.3, True, 48), ([], None, 0.3, True, 7), ([], None, 0.3, True, 1), ([], None, 0.3, True, 24), ([], None, 0.0, False, 24), ([], None, 0.3, True, 24)]
    assert [tuple(r)[1:] for r in got] == want
    links = spark.createDataFrame([(k, p) for k in range(8) for p in ((1, 2) if k < 4 else (1,))] + [(20, 3)], "photo_id long, person_id long")
    photos = spark.createDataFrame([(k, k) for k in range(30)], "photo_id long, taken_at int")
    got = stories.people_stories(photos, links).groupBy("story").count().collect()
    assert {x["story"]: x["count"] for x in got} == {"people:Together": 4, "people:Solo 1": 4}


def test_taste(spark):
    r = np.random.default_rng(5)
    rows = [(k, (r.normal(size=16) + np.where(np.arange(16) < 4, 1.5 if k % 2 else -1.5, 0)).tolist(), "keep" if k % 2 else "reject") for k in range(160)]
    df = spark.createDataFrame(rows, "photo_id long, embedding array<double>, decision string")
    lab = taste.labelled(df.select("photo_id", "embedding"), df.select("photo_id", "decision"))
    w, b = taste.train_taste(lab)
    far, c = taste.train_taste(lab, steps=3, local_bytes=0)
    near, e = taste.train_taste(lab, steps=3)
    assert np.allclose(far, near) and c == pytest.approx(e)  # the distributed sum of gradients
    scored = taste.taste_scores(df.select("photo_id", "embedding"), w, b).join(df, "photo_id")
    assert aggregate.rank_auc(scored, F.col("decision") == "keep", "taste").first()["auc"] > 0.9
    with pytest.raises(ValueError):
        taste.train_taste(lab.limit(60))
    split = {x["photo_id"]: x["held_out"] for x in taste.held_out(lab).collect()}
    assert [sum(h for i, h in split.items() if i % 2 == y) for y in (0, 1)] == [16, 16] and len(split) == 160
    said = taste.taste_report(lab, steps=60).first()
    assert said["n_samples"] == 160 and said["auc"] > 0.9 and said["weight"] == pytest.approx(0.4 * 60 / 900) and len(said["w"]) == 16


def test_report_of_a_library_beyond_the_cap(spark):
    rows = [(k, str(k), 0.5, 10, [1.0, 0.001 * k] if k < 3 else [0.0, 1.0] if k == 3 else [-1.0, float(k)]) for k in range(5)]
    p = spark.createDataFrame(rows, "photo_id long, sha256 string, iqa double, size_bytes long, embedding array<double>")
    report = lambda most: {x["kind"]: x["photos"] for x in dedup.report(p, most=most).collect()}
    assert report(4) == {} and report(None) == {"near": 5}

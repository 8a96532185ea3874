import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lumiquarry.llm import ngram_join as nj

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(docs, size, percent):
    sets = {i: grams(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, ids = dict.fromkeys(sets, 0), sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 60)])
def test_against_brute_force(spark, copies, size, percent, monkeypatch):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in nj.jaccard_components(df, size=size, percent=percent).collect()}
    assert got == brute(copies, size, percent)


def test_signatures_miss_no_link():
    """Random linked pairs of all sizes, at the very bound, share a signature."""
    r = np.random.default_rng(5)
    for percent in (60, 80, 85, 95):
        bounds = nj.Bounds(percent)
        for _ in range(300):
            n = int(r.integers(1, 400))
            a = r.integers(0, 2**63, n, dtype=np.uint64)
            off = int((1 - percent / 100) * n)
            b = np.concatenate([a[off // 2 :], r.integers(0, 2**63, off // 2, dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * len(np.union1d(a, b)) or set(a) == set(b):
                continue
            a, b = np.unique(a), np.unique(b)
            sig, row = bounds.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert set(sig[row == 0]) & set(sig[row == 1])


def test_tiles_and_stars_give_the_same(spark, copies, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 16)
    monkeypatch.setattr(nj, "COLUMNS", 64)
    a, b = nj.Bounds(80), np.random.default_rng(1)
    flat = [np.unique(b.integers(0, 40, 30).astype(np.uint64)) for _ in range(50)]
    place = np.concatenate([[0], np.cumsum([len(x) for x in flat])])
    got = nj.product((np.concatenate(flat), place), (np.concatenate(flat), place), a)
    want = np.array([[100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)) for y in flat] for x in flat])
    assert (got == want).all()


@pytest.mark.parametrize("tile", [2, 16, 512])
def test_classes_without_links(spark, copies, monkeypatch, tile):
    """Blocks of many tiles: a hub of near copies, chains whose ends do not link, and strangers that share its passage."""
    monkeypatch.setattr(nj, "TILE", tile)
    r = random.Random(6)
    chain = [f"c{k}" for k in range(60)]
    docs = list(copies)
    for k in range(40):  # each text links with the next few only
        chain[(3 * k) % 60] = f"d{k}"
        docs.append((10_000 + k * 7 % 40, " ".join(chain)))
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = nj.jaccard_components(df, size=4, percent=60, links=False).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows} == {i: x[:2] for i, x in brute(docs, 4, 60).items()}
    assert all(x["n_links"] is None for x in rows)


def test_edges(spark, edge_docs, no_docs):
    rows = nj.jaccard_components(edge_docs, size=4, percent=85).collect()
    assert len(rows) == edge_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["n_shingles"] for r in by[0]] == [0] and by[0][0]["component_id"] == 0
    assert {r["component_id"] for r in by[8]} == {6} and by[10][0]["component_id"] == 9
    assert all(r["component_id"] is None for r in by[None])
    assert nj.jaccard_components(no_docs).count() == 0
    kept = nj.keep_one(edge_docs, size=4, percent=85)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {None, 0, 1, 2, 3, 4, 6, 9, 11, 12, 13}


def test_counts_are_lower_bounds():
    r = np.random.default_rng(8)
    for n, m in ((1500, 1500), (1200, 2600), (5000, 4000), (40_000, 39_000)):
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], r.integers(0, 2**64, m - n // 2, dtype=np.uint64)]))
        assert 0 < nj.apart_at_least(nj.fine_counts(a), nj.fine_counts(b)) <= len(np.setxor1d(a, b))


def test_long_texts(spark):
    r = np.random.default_rng(3)
    docs = []
    for k in range(12):
        words = [f"w{x}" for x in r.integers(0, 10**6, 3000)]
        for c in range(3):
            copy = list(words)
            for at in r.integers(0, 3000, 20 * c):
                copy[at] = "other"
            docs.append((3 * k + c, " ".join(copy)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in nj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs, 5, 80)


def test_stars_of_one_task_lose_no_link(spark, monkeypatch):
    """Short texts of 60 templates with a word of their own, and of each template one again in another partition with a word appended."""
    monkeypatch.setattr(nj, "LOCAL_GROUP", 2)
    docs = [(6 * t + k, " ".join([f"t{t}_{x}" for x in range(13)] + [f"own{t}_{k}"])) for t in range(60) for k in range(6)]
    docs += [(360 + t, f"{docs[6 * t + 1][1]} more") for t in range(60)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(docs, 7), "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["n_links"]) for x in nj.jaccard_components(df, size=4, percent=85).collect()}
    assert got == brute(docs, 4, 85)


PYTHON = ("MapInArrow", "FlatMapGroupsInPandas", "MapInPandas", "PythonMapInArrow")


def python_steps(node, above=0):
    """The most Python steps that one task of a physical plan runs, one upon the other."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return python_steps(node.initialPlan(), above)
    here = 0 if "Exchange" in name else above + (name in PYTHON)
    return max([here, *(python_steps(node.children().apply(k), here) for k in range(node.children().length()))])


@pytest.mark.parametrize("links", [True, False])
def test_no_task_takes_two_workers(spark, copies, links, monkeypatch):
    """Each Python step of a task has a worker of its own, and idle ones stay in an executor's memory."""
    from lumiquarry.operators import graph

    seen, written = [], nj.written

    def noted(df, what):
        seen.append((what, python_steps(df._jdf.queryExecution().executedPlan())))
        return written(df, what)

    monkeypatch.setattr(nj, "written", noted)
    monkeypatch.setattr(graph, "written", noted)
    df = nj.jaccard_components(spark.createDataFrame(copies, "doc_id long, text string"), size=4, percent=60, links=links)
    seen.append(("classes", python_steps(df._jdf.queryExecution().executedPlan())))
    assert max(n for _, n in seen) == 1, seen


def test_batches_are_handed_on_in_small_slices():
    """Whatever a task has gathered, no batch of many rows is larger than about a megabyte."""

    class Steps(list):
        def mapInArrow(self, run, _):
            self.append(run)
            return self

        def repartition(self, *_):
            return self

    r = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 10**6, 400)) for _ in range(1200)]
    first, second = nj.signed(Steps(), 5, nj.Bounds(80), 40)
    made = list(first(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(2400)), pa.array([f"{t}{x}" for t in texts for x in ("", " more")])], names=["id", "text"])])))
    blobs = [b for b in made if b.column("sigs").null_count < b.num_rows]
    assert sum(b.nbytes for b in blobs) > 2 << 20 and max(b.nbytes for b in blobs) < 1.2 * (1 << 20)
    near = list(second(iter(made)))
    assert sum(b.num_rows for b in near) >= 2400 and max(b.nbytes for b in near) < 1.2 * (1 << 20)


def test_pairs_of_signatures_and_nodes_come_back():
    r = np.random.default_rng(2)
    for n, high in ((1, 64), (7, 64), (5000, 64), (5000, 44)):
        sig, node = np.sort(r.integers(0, 2**high, n, dtype=np.uint64)), r.integers(0, 2**48, n)
        got = nj.unsqueezed(nj.squeezed(sig, node))
        assert (got[0] == sig & ~np.uint64(0xFFFF)).all() and (got[1] == node).all()
    assert len(nj.squeezed(sig, node)) < 11 * n


def test_what_is_spared_leaves_a_signature():
    """Linked sets share more signatures of the larger one's binning than either may leave out, or both may leave out none and share a first hash."""
    r = np.random.default_rng(6)
    pairs = 0
    for percent in (60, 80, 85):
        bounds = nj.Bounds(percent)
        for _ in range(300):
            n = int(r.integers(5, 600))
            a = r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
            off = int((1 - percent / 100) * n)
            a, b = np.unique(a), np.unique(np.concatenate([a[off // 2 :], r.integers(0, 2**63, off // 2, dtype=np.uint64) * np.uint64(2)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < percent * len(np.union1d(a, b)) or set(a) == set(b):
                continue
            sig, row, spare = bounds.spared(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            k = spare[:, 0].max()
            mine = [set(sig[row == i]) for i in (0, 1)]
            shared = [int(s) >> nj.CLASS_AT & 255 for s in mine[0] & mine[1]]
            may = [spare[i, k - spare[i, 0] + 1] for i in (0, 1)]
            assert shared.count(k) > max(may) if max(may) >= 0 else nj.FIRST_HASHES in shared
            pairs += max(may) > 0
    assert pairs > 100


def test_a_common_passage_makes_no_block(spark, monkeypatch):
    """300 texts with one passage of 40 words, of 20 of them a near copy, and 30 near copies of one text: links as by brute force, no block of strangers."""
    monkeypatch.setattr(nj, "LOCAL_GROUP", 4)
    monkeypatch.setattr(nj, "GROUP", 8)
    blocks, written = [], nj.written

    def noted(df, what):
        out = written(df, what)
        blocks.extend(r["rep"] for r in (out.select("rep").collect() if what == "blocks" else ()))
        return out

    monkeypatch.setattr(nj, "written", noted)
    r = random.Random(12)
    passage, own = [f"common{x}" for x in range(40)], [[f"w{r.randrange(10**9)}" for _ in range(120)] for _ in range(300)]
    texts = [w[: (at := r.randrange(120))] + passage + w[at:] for w in own]
    texts += [[*t[:50], "other", *t[51:]] for t in texts[:20]] + [[*texts[0], f"more{x}"] for x in range(30)]
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = nj.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), links=False).collect()
    want = brute(docs, 5, 80)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == {i: x[:2] for i, x in want.items()}
    assert len(blocks) < 100  # 70 of them linked


def test_near_copies_are_not_sent_to_all_tiles(spark, monkeypatch):
    """What keep_one sends to products grows with a group of near copies, not with the square of its tiles."""
    monkeypatch.setattr(nj, "TILE", 4)
    sent, products = [], nj.products

    def noted(sets, bounds):
        sent.append(sum(len(r["meets"]) for r in sets.select("meets").collect()))
        return products(sets, bounds)

    monkeypatch.setattr(nj, "products", noted)
    docs = [(k, " ".join([*(f"w{x}" for x in range(200)), f"own{k}"])) for k in range(128)]
    kept = nj.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert [r["doc_id"] for r in kept] == [0]
    assert sum(sent) < 4 * len(docs), sent

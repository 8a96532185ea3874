"""The filter interaction audit: against applying every order to every document."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lumiquarry.llm import filter_audit as m

LABELS = "doc_id long, quality int, toxic int, part string"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
    }


def brute(docs, labels):
    labels = [x for x in labels if x[0] is not None]
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    rows = []
    for i, text, lang in docs:
        f = fails(text or "")
        f["E"] = i is not None and any((t or "") == (text or "") and j is not None and j < i for j, t, _ in docs)
        rows.append((lang or "", {x for x in f if f[x]}, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {p for p, *_ in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for k, x in enumerate(order):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                out[part, "".join(order), k + 1] = (len(left), len(gone), sum(x in r[0] for r in mine) - len(gone), sum(r[0] == {x} for r in mine), sum(r[1] for r in gone), sum(r[2] for r in gone))
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*x, None, None, None) for x in docs], "doc_id long, text string, lang string, part string, mask int, digest string")
    lab = spark.createDataFrame([(*x, None) for x in labels], LABELS)
    got = m.interaction_audit(m.failure_cells(d, lab), "ABCDE").collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}, len(got)


def test_against_every_order(spark):
    r = random.Random(4)
    long = " ".join(r.choice(["alpha", "Beta", "x%y"]) + str(k) for k in range(60_000))
    words = [f"w{k}" for k in range(400)] + ["BIG", "HUGE", "Aa", "État", "\U0001f642"]
    docs = [(0, None, None), (1, "", "en"), (2, "  \n\t ", "en"), (3, long, "de"), (4, long, "de"), (None, long, "en"), (None, None, "fr"), (3, long, "de"), (3, "other text", "de")]
    for i in range(10, 120):
        text = " ".join(r.choices(words[: r.choice([20, 405])] + ["SHOUT"] * r.choice([0, 60]), k=r.choice([5, 60, 99, 100, 101, 300])))
        docs.append((i, text + r.choice(["", "", " #tag", " 50%"]), r.choice(["en", "de", None])))
    docs += [(i, docs[-40][1], r.choice(["en", "es"])) for i in range(200, 260)]  # a third are copies of one text
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 260, 2)] + [(3, 1, 0), (3, 1, 0), (None, 1, 1)]
    got, n = audited(spark, docs, labels)
    assert got == brute(docs, labels) and n == len(got) == 600 * len({d[2] or "" for d in docs})


def test_no_labels_and_no_documents(spark):
    docs = [(1, "a", "en"), (2, "a", "en")]
    assert audited(spark, docs, [])[0] == brute(docs, [])
    assert audited(spark, [], [(1, 1, 1)])[1] == 0


def test_own_filters(spark):
    """Any filters over ``text``, without the one for copies; more letters than a recursion can hold are refused."""
    d = spark.createDataFrame([(1, "a b", "x"), (2, "b", "x"), (3, "c", "y")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], LABELS)
    cells = m.failure_cells(d, none, filters={"P": F.col("text").contains("a"), "Q": F.col("text").contains("b")}, copies=None)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in m.interaction_audit(cells, "PQ").collect()}
    assert got == {("x", "PQ", 1): (1, 1, 0), ("x", "PQ", 2): (0, 1, 1), ("x", "QP", 1): (0, 2, 0), ("x", "QP", 2): (0, 0, 1), ("y", "PQ", 1): (1, 0, 0), ("y", "PQ", 2): (1, 0, 0), ("y", "QP", 1): (1, 0, 0), ("y", "QP", 2): (1, 0, 0)}
    with pytest.raises(ValueError):
        m.interaction_audit(cells, "ABCDEFG")

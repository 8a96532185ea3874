import random
import re

import pytest

from lumiquarry.llm import licenses as lic


def grams(t):
    w = re.findall(r"[a-z0-9]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, percent=80, templates=lic.TEMPLATES):
    out = []
    for d, t in docs:
        own = grams(t)
        for name, text in templates:
            need = grams(text)
            if 100 * len(own & need) >= percent * len(need):
                out.append((d, name, len(own & need), len(need)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(9)
    docs = []
    for k in range(300):
        words = [r.choice(["the", "of", "license", "this", "work", "is", "w1", "w2"]) for _ in range(r.choice([0, 4, 30, 300]))]
        text = r.choice(lic.TEMPLATES)[1].split()
        for _ in range(r.choice([0, 0, 1, 3])):
            text[r.randrange(len(text))] = "zz"
        at = r.randrange(len(words) + 1)
        docs.append((k, " ".join(words[:at] + text + words[at:]).upper() if k % 2 else "\n".join(words[:at] + text + words[at:])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(((x["doc_id"], x["license_id"], x["n_shared"], x["n_shingles"]) for x in lic.license_matches(df).collect()), key=repr)
    assert got == brute(docs)


def test_long_templates_in_blocks(spark, monkeypatch):
    """Whole licences of hundreds of words, changed by up to a sixth, in several passes over the texts."""
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    templates = [(f"t{k}", " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate((5, 40, 300, 700))]
    docs = []
    for k in range(60):
        text = templates[k % 4][1].split()
        for _ in range(r.choice([0, 0, 1, len(text) // 40])):
            text[r.randrange(len(text))] = "zz"
        noise = [r.choice(words) for _ in range(r.choice([0, 50, 900]))]
        at = r.randrange(len(noise) + 1)
        docs.append((k, " ".join(noise[:at] + text + noise[at:])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, templates=templates)
    assert len({name for _, name, _, _ in want}) == 4
    for most in (lic.MOST, 100):
        monkeypatch.setattr(lic, "MOST", most)
        assert sorted(((x["doc_id"], x["license_id"], x["n_shared"], x["n_shingles"]) for x in lic.license_matches(df, templates).collect()), key=repr) == want


def test_edges(spark, edge_docs, no_docs):
    assert lic.license_matches(edge_docs).count() == 0 and lic.license_matches(no_docs).count() == 0
    df = spark.createDataFrame([(1, "x Released under the MIT License. y", 5, "n")] * 2 + [(None, "Released under the MIT License.", 5, "n")], "doc_id long, text string, row int, name string")
    assert lic.license_matches(df).count() == 3
    with pytest.raises(ValueError):
        lic.license_matches(df, [("short", "one two three four")])

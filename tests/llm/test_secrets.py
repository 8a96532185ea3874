import hashlib
import re

from lumiquarry.llm import secrets as s

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
TEXTS = [
    "token = abcdefgh", "TOKEN: 'short' password=token=12345678", "secretsecret: abcdefghij api_key==x ApiKey = \"0123456789abcdef0123456789abcdef\"", "AKIA AKIAABCDEFGHIJKL AKIAAKIA0123456789", "deadbeef" * 5 + "G" + "a" * 31,
    "İ token=abcdefghé AKIA0123456789ABCDE İİ " + "0" * 32, "passwd  :  \"qqqqqqqq\" token token: token: abcdefgh", "", None, "ſecret=abcdefgh", "api_key=" + "f" * 40,
]


def brute(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_base_spans_against_brute_force(spark):
    found = s.automaton()
    for t in TEXTS:
        assert [x for x in s.scan(t or "", found) if x[1] < 3] == brute(t)


def test_checksums():
    body = "a1B2" * 7 + "zz"
    good, bad = "ghp_" + body + s.checksum(body), "ghp_" + body + "000000"
    found = s.automaton()
    assert [x[1] for x in s.scan(f"see {good}, not {bad} npm_{body}{s.checksum(body)}", found)] == [3, 4]


def test_rows_of_the_query(spark, tmp_path):
    """The query's own columns against plain loops, over texts, nulls and the test tables' documents."""
    body = "a1B2" * 7 + "zz"
    texts = TEXTS + [f"see ghp_{body}{s.checksum(body)} and token=npm_{body}{s.checksum(body)}"]
    spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        text_of = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        rows = s.op9_secret_scans(spark, folder).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(text_of)
        for r in rows:
            t = text_of[r["doc_id"]] or ""
            base = brute(t)
            more = [(m.start(), k, m.end()) for k, lead in ((3, "gh[pousr]"), (4, "npm")) for m in re.finditer(lead + r"_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", t) if s.checksum(m[1]) == m[2]]
            assert [r[f"n_{k}"] for k in s.BASE_KINDS] == [sum(x[1] == i for x in base) for i in range(3)]
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
            assert r["spans"] == ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + more))


def test_query_and_redaction(spark, edge_docs, no_docs):
    rows = [(k, t, len(t or "")) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    for r in s.secret_spans(df).collect():
        assert [(x["start"], s.KINDS.index(x["kind"]), x["end"]) for x in r["secrets"]] == brute(TEXTS[r["doc_id"]])
    clean = {r["doc_id"]: r for r in s.redact_secrets(df).collect()}
    assert clean[0]["text"] == "[SECRET]" and clean[0]["n_chars"] == 8 and clean[8]["text"] is None
    assert clean[5]["text"].startswith("İ [SECRET]é [SECRET] İİ [SECRET]")
    assert not any(brute(r["text"]) for r in clean.values())
    out = s.redact_secrets(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    assert s.secret_spans(edge_docs).count() == edge_docs.count() and s.secret_spans(no_docs).count() == 0

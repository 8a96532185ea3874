import corpus_pipeline as cp
import sentencepiece
import public_tokenizers

from lumiquarry.llm import quality, secrets
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_ngram_join import brute as classes

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert len(names) == 5
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    before, kept = docs, None
    for k, (_, stage) in enumerate(cp.STAGES):
        after = stage(spark, before, SF).cache()
        old = [(r["doc_id"], r["text"]) for r in before.collect()]
        new = {r["doc_id"]: r for r in after.collect()}
        if k < 4:
            assert after.columns == docs.columns
        if k == 0:
            want = {r["doc_id"] for r in quality.scored(docs, model).where("score >= 0.3").collect()}
        elif k == 1:
            want = {i for i, (_, c, _) in classes(old, 5, 80).items() if i == c}
        elif k == 2:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {d for d, _, n, _ in hits(old, items) if not n}
        else:
            want = {i for i, _ in old}
        assert set(new) == want
        if k == 3:
            found = secrets.automaton()
            assert all((new[i]["text"] == t) == (not secrets.scan(t, found)) and not secrets.scan(new[i]["text"], found) for i, t in old)
        if k == 4:
            own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            assert all(new[i]["tokens"] == own.encode(t) for i, t in old)
        before = after if kept is None else kept
    assert cp.run(spark, SF).count() == len(new)


def test_stages_bear_edges(spark, edge_docs, no_docs):
    clash = edge_docs.withColumnsRenamed({"id": "quality_score", "row": "_bit", "items": "n_words"})
    for frame in (edge_docs, clash, no_docs):
        docs = frame
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == frame.columns
        assert cp.STAGES[-1][1](spark, docs, SF).count() <= frame.count()


def test_run_bears_empty_tables(spark, tmp_path):
    """Without labels every text stays, without a benchmark none is contaminated, and without documents there are no rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for name, rows in (("some", docs), ("none", docs.where("false"))):
        for table, df in (("documents", rows), ("labels", labels), ("benchmark", benchmark)):
            df.write.parquet(str(tmp_path / name / f"{table}.parquet"))
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {i for i, (_, c, _) in classes(texts, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in cp.run(spark, str(tmp_path / "some")).collect()} == want
    assert cp.run(spark, str(tmp_path / "none")).count() == 0

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumiquarry.llm import pieces_codec, textbytes, token_store
from lumiquarry.session import shared_folder
from tests.llm.conftest import thue_morse

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  a  b\n\tc ", "it's we'll 123abc  4 \n", "plain <|endoftext|> x", "a×b ÷ c", "İstanbul ﬁ 你好世界 \U0001f642\U0001f642", " " * 41 + "x", "a" * 300, "The quick brown fox's 12345 dogs... !!!!", "hello▁world", "<s> </s> <0x0A>", "привет мир",
    "é　 \x00", "\n\n a\n b  ", "=====----=====", "trail   ", "naïve Ärger ʻokina ɐ", "don't'll 're",
]


def frame(spark, docs=None):
    return spark.createDataFrame(docs or list(enumerate(TEXTS)), "doc_id long, text string")


def test_token_files(spark, edge_docs):
    own = Tokenizer.from_file(BPE)
    path = shared_folder(spark, "t")
    token_store.write_tokens(frame(spark).repartition(4), path, BPE)
    rows = sorted(token_store.read_tokens(spark, path).collect(), key=lambda r: r["doc_id"])
    at = 0
    for r, t in zip(rows, TEXTS, strict=True):
        want = own.encode(t or "", add_special_tokens=False).ids + [0]
        assert (r["tokens"], r["n_tokens"], r["start"]) == (want, len(want), at)
        at += len(want)
    crc = {r["doc_id"]: r["ids_crc32"] for r in token_store.with_crc32(token_store.read_tokens(spark, path)).collect()}
    assert crc == {r["doc_id"]: zlib.crc32(np.array(r["tokens"], "<u4").tobytes()) for r in rows}
    plan = token_store.read_tokens(spark, path).where("doc_id = 7")
    assert plan.count() == 1


def scanned_rows(df):
    """How many rows the scans of an executed plan gave."""
    node, seen = df._jdf.queryExecution().executedPlan(), 0
    todo = [node.finalPhysicalPlan() if node.nodeName() == "AdaptiveSparkPlan" else node]
    while todo:
        n = todo.pop()
        if n.nodeName().startswith("Scan"):
            seen += n.metrics().apply("numOutputRows").value()
        kids = n.children()
        todo += [kids.apply(k) for k in range(kids.size())]
        if n.nodeName().endswith("QueryStage"):
            todo.append(n.plan())
    return seen


def test_one_document_is_read_from_metadata(spark):
    """A filter on the id reads the row group that may hold it, and nothing where no Bloom filter has it."""
    docs = spark.range(8000).select((F.col("id") * 2).alias("doc_id"), F.format_string("text %d", "id").alias("text"))
    path = shared_folder(spark, "t")
    token_store.write_tokens(docs.coalesce(1), path, BPE, stride=1000)
    stored = spark.read.schema("doc_id long, part int, at long, n_tokens long, tokens array<int>").orc(path)
    for id_, found, most in ((4002, 1, 1000), (4003, 0, 1000), (99_999, 0, 0)):
        one = stored.where(f"doc_id = {id_}")
        assert len(one.collect()) == found and scanned_rows(one) <= most
    assert token_store.read_tokens(spark, path).where("doc_id = 4002").first()["tokens"] == Tokenizer.from_file(BPE).encode("text 2001").ids + [0]


def test_token_files_edges(spark, edge_docs, no_docs):
    path = shared_folder(spark, "t")
    token_store.write_tokens(edge_docs, path, BPE)
    got = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert len(got) == edge_docs.count() and got[0]["doc_id"] is None and got[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got[:-1], got[1:], strict=True))
    path = shared_folder(spark, "t")
    token_store.write_tokens(no_docs, path, BPE)
    assert token_store.read_tokens(spark, path).count() == 0


def test_encoder_remembers_across_batches(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBER", 4)
    own, enc = Tokenizer.from_file(BPE), token_store.Encoder(BPE)
    for _ in range(3):
        ids, n = enc.batch(pa.array(TEXTS))
        assert ids.tolist() == [i for t in TEXTS for i in own.encode(t or "", add_special_tokens=False).ids]


def test_memos_tell_chunks_apart_by_bytes(monkeypatch):
    """Both codecs stay right where nearly all chunks share a hash, and on words that polynomial hashes confuse."""
    words = thue_morse()
    texts = TEXTS + [" ".join(words), *words]
    real = textbytes.hashes
    for hash_ in (real, lambda d, b, e: real(d, b, e) % np.uint64(3)):
        monkeypatch.setattr(textbytes, "hashes", hash_)
        own, enc = Tokenizer.from_file(BPE), token_store.Encoder(BPE)
        pieces, codec = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces_codec.Codec(PIECES)
        for _ in range(2):
            assert enc.batch(pa.array(texts))[0].tolist() == [i for t in texts for i in own.encode(t or "", add_special_tokens=False).ids]
            assert codec.encode([t or "" for t in texts])[0].tolist() == [i for t in texts for i in pieces.encode(t or "")]


def test_pieces_equal_the_library():
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = pieces_codec.Codec(PIECES)
    for _ in range(2):
        ids, n = codec.encode([t or "" for t in TEXTS])
        at = 0
        for t, k in zip(TEXTS, n, strict=True):
            assert ids[at : at + k].tolist() == own.encode(t or "")
            at += k
    data, size = codec.decode(ids, n)
    ends = np.cumsum(size)
    assert [bytes(data[e - k : e]).decode() for e, k in zip(ends, size, strict=True)] == [(t or "").replace("▁", " ") for t in TEXTS]


def test_pieces_on_frames(spark, edge_docs, no_docs):
    rows = {r["doc_id"]: r for r in pieces_codec.encoded(frame(spark), PIECES).collect()}
    assert [k for k, r in rows.items() if not r["round_trip"]] == [TEXTS.index("hello▁world")]
    assert pieces_codec.encoded(edge_docs, PIECES, keep=("lang", "id")).count() == edge_docs.count()
    assert pieces_codec.encoded(no_docs, PIECES).count() == 0


@pytest.mark.parametrize("n", range(1, 40))
def test_runs_of_blanks(n):
    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids, _ = pieces_codec.codec(PIECES).encode([" " * n + "\n"])
    assert ids.tolist() == own.encode(" " * n + "\n")

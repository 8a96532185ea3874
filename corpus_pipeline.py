"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents.

Rejected texts go, one text of each near-duplicate class stays (five-word n-grams, similarity 0.8 or more), contaminated
texts go, secrets are blotted out of the texts that hold them, and what is left becomes token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiquarry.llm import decontaminate, ngram_join, pieces_codec, quality, secrets
from lumiquarry.session import table, written

#: Scores from which the quality classifier keeps a text.
KEEP_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a classifier trained on the labels does not reject.

    Without usable labels (no row, or all null) every text scores 0.5 and stays. Null and empty texts have the score of no
    features; repeated rows are judged each; an empty table gives no rows; no column is lost, whatever its name.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = "quality_score"
    while score in docs.columns:
        score += "_"
    return quality.scored(docs, model, score_col=score).where(F.col(score) >= KEEP_SCORE).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest id.

    Null, empty and blank texts are in no class and stay, as do rows with a null id; of rows that repeat the standing id
    all stay. An empty table gives no rows.
    """
    return ngram_join.keep_one(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no ten consecutive words of a benchmark item, nor all words of a shorter one.

    Null and empty texts hold none and stay; items that are null or without words match nothing, so with an empty
    benchmark all documents stay. Repeated rows are judged each.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and n_chars counted anew. Null and empty texts stay as they are."""
    return secrets.redact_secrets(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text: doc_id, lang, source, tokens, n_tokens, ids_crc32, round_trip. Null and empty texts have none; no row goes."""
    return pieces_codec.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("lang", "source"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: A trained classifier and a tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again. Empty documents, labels or benchmark are borne: see the stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to token ids: five stages, each one operator over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of
``documents``.  ``run`` writes each stage's rows to the folder in
``spark.checkpoint.dir`` and reads them again, so a lost executor repeats one
stage at most.

Defined results: a row without text fails the quality rules and goes, whatever its other columns hold; so does a text without a
letter, at the latest in the second stage.  Of rows that repeat as a whole, or share doc_id and shingles, the third
stage keeps one; a null doc_id is no name, so of two such rows with different texts both stay.  Texts of any length are read whole, ties go to
the least doc_id, other columns, whatever their names, are carried along; an empty table gives an empty table, and an
empty benchmark (or items without words) leaves all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import decontaminate, jaccard, langid, pieces, quality, registry
from seriesloom.llm.common import keep, table
from seriesloom.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weak supervision over quality rules; rejected documents go."""
    ship(spark)
    return quality.filter_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hashed subword classifier, learnt from the stage's own rows; documents whose language is not accepted go."""
    ship(spark)
    return langid.filter_language(docs, registry.language_model(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join, five words and 0.8; the document of the least id stays of each group."""
    ship(spark)
    return jaccard.keep_one(docs, size=5, least=(80, 100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Winnowing against the benchmark; documents with a window of any item go (a shorter item, from five words on, is one window)."""
    return decontaminate.filter_clean(docs, table(spark, sf_dir, "benchmark"), items=1, shortest=decontaminate.K)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what is left."""
    ship(spark)
    return pieces.encode(docs, registry.model_path(), carry=["doc_id"])


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", token_ids),
]

#: EM, SGD and SentencePiece are beyond SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = keep(out, "stage") if n < len(STAGES) - 1 else out
    return docs

"""From raw documents to token ids: STAGES applied in order, each written and read again.

Every stage takes the documents that its predecessor kept, with the columns of the documents table, and
returns those it keeps with the same columns; the last one returns token ids.  Models are fitted on
what is there: the languages on the `lang` of the documents, toxicity on the `labels` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import langid, mixing, pieces, simhash, toxicity
from graphloom.llm.common import fresh, scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that have no words or are mostly in no known language (nulls and empty texts among them)."""
    return langid.drop_unknown(docs, langid.train(docs))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic texts."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the least doc_id."""
    return simhash.drop_near_duplicates(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that sources meet their target weights; repeated rows are alike."""
    return mixing.mix_documents(docs, copy_col=(copy := fresh(docs, "copy"))).drop(copy)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip, lang, source) of every row."""
    return pieces.encode(docs, "doc_id", "text", pieces.MODEL_PATH, "lang", "source")


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece", tokenize),
]

#: Trained models and Viterbi are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import chat, hnsw, langid, licenses, mixing, pieces, simhash, sketch, sstable, toxicity
from graphloom.llm.common import table


def op1_simhash_near_dedup(spark, sf_dir):
    # one row a document: its group, named by the least doc_id, and how many fingerprints are near to its own
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "links", "keep")


def op2_sentencepiece(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark, sf_dir):
    # every row whose id is divisible by 100 is a query, against all rows
    return hnsw.nearest_neighbours(table(spark, sf_dir, "embeddings"), queries=F.col("id") % 100 == 0)


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_source_mixing(spark, sf_dir):
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_chars", "copy")


def op6_sstable_output(spark, sf_dir):
    return sstable.token_shards(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark, sf_dir):
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op8_bottom_k_fingerprints(spark, sf_dir):
    return sketch.fingerprints(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op10_license_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_source_mixing": mixing.SQL, "op6_sstable_output": sstable.SQL}

"""A training corpus from the documents table: rejected documents go, one of each group of near copies stays, documents
with benchmark passages go, personal data is replaced, and what is left is encoded. Each stage is written and read again
as the next one's documents, so a lost executor costs a stage's tasks and nothing before it.

Nulls: a null text is scored as an empty one and, if it stays, is encoded as one; a null doc_id is a document of its own.
Empty and very long texts go through every stage whole. Rows repeated under one doc_id are one document to the stage of
near copies, of which all stay or go, and a row each to the others; of copies the least doc_id stays. An empty table of
documents gives no rows; an empty table of labels rejects nothing, an empty benchmark finds nothing. Extra columns of
documents are carried through all stages but the last, whatever their names, but for the name __gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import table, written
from quire.llm.decontam import decontaminate
from quire.llm.minhash import drop_near_duplicates
from quire.llm.pieces import encoded_corpus
from quire.llm.pii import redact
from quire.llm.quality import keep_good
from quire.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoded_corpus(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("private_data", private_data), ("encoding", encoding)]

#: No stage but the last's hashes can be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

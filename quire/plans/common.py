"""What plans share: tables, and the SQL of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, dealt over all cores where its files are too few to fill them; a large table is left as it lies."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


#: The lines of documents, as quire.sources.texts.document_lines has them.
LINES = r"""
    raw_lines as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as line_no from documents),
    lines as (select doc_id, line_no::bigint as line_no, trim(regexp_replace(raw, '\s+', ' ', 'g')) as line from raw_lines where trim(regexp_replace(raw, '\s+', ' ', 'g')) <> '')
"""

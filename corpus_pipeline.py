"""The corpus pipeline: five stages from raw documents to packed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quizmill.llm import exact_dedup, jaccard_join, mixing, packing, quality
from quizmill.llm.common import new_path, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the classifier rejects go.

    Null and empty texts score alike and stay or go together, as do repeated rows
    and equal texts; long texts are scored whole; a score at the threshold stays.
    Rows without doc_id are scored too. All columns come out as they were. No
    rows, or no labels, give no rejections.
    """
    return quality.accepted_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of equal texts stays.

    The longest original stays, of equally long ones the smallest doc_id; null and
    empty texts are one group; texts are compared whole. Rows that repeat a doc_id
    stay or go together, rows without doc_id all stay. All columns come out as
    they were. No rows give no rows.
    """
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of near copies stays, the smallest doc_id.

    Documents without words, null texts among them, all stay; texts are compared
    whole. Rows that repeat a doc_id stay or go together, rows without doc_id all
    stay. All columns come out as they were. No rows give no rows.
    """
    return jaccard_join.one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: every document as often as its source's rate says.

    Null sources are a source; documents without words weigh nothing and come out
    by the same draw, which hashes the doc_id, so repeated rows draw alike. Texts
    are counted whole. All columns come out as they were. No rows give no rows.
    """
    return mixing.mixed_documents(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: length buckets and token-budget batches.

    Null and empty texts have no tokens and join the shortest bucket, a text longer
    than the budget is a batch of its own, and repeated rows and copies take slots
    of their own. Only doc_id and text are read. No rows give no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("length_bucket_packing", pack_batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next stage's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The classifier is trained, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL = None

"""Exam tables over the warehouse's Parquet tables.

Each concept of the exam model is a narrow view, so that scans read only the
columns that a query uses and filters reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The views over one data directory."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def users(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))

    def attempts(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(
            F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("user_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("test_id"),
            F.when(F.col("o_orderstatus") == "O", "STARTED").otherwise("COMPLETED").alias("status"),
            F.col("o_orderdate").alias("started_at"),
            F.when(F.col("o_orderkey") % 5 == 0, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("scope_part"),
            F.col("o_totalprice").alias("score"),
        )

    def tests(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(F.substring("o_orderpriority", 1, 1).cast("int").alias("test_id"), F.col("o_orderpriority").alias("title")).distinct().withColumn("published", F.col("test_id") <= 3)

    def questions(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("question_id"), (F.col("p_partkey") % 5 + 1).cast("int").alias("test_id"),
            (F.col("p_partkey") % 7 + 1).cast("int").alias("part_number"), (F.col("p_partkey") % 200 + 1).cast("int").alias("question_number"),
            letter_of(F.col("p_partkey")).alias("correct"), F.col("p_brand").alias("group_name"), F.col("p_name").alias("question_text"), F.col("p_type").alias("passage"), F.col("p_size").alias("size"),
        )

    def answers(self) -> DataFrame:
        """Append log of answers; a later answer to the same question replaces the earlier one."""
        i = self.raw("lineitem")
        return i.select(
            F.col("l_orderkey").alias("attempt_id"), F.col("l_partkey").alias("question_id"), F.col("l_returnflag").alias("selected"),
            F.struct(F.col("l_shipdate").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_suppkey").alias("c"), F.col("l_extendedprice").alias("d")).alias("version"),
        )

    def words(self) -> DataFrame:
        e = self.raw("events")
        return e.select(F.col("event_id").alias("word_id"), "user_id", F.col("event_type").alias("word"), F.col("ts").alias("created_at"), "value", "props")

    def documents(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text", "source")

    def boxes(self) -> DataFrame:
        """(vec_id, x, y, w, h) from the first four components, as non-negative doubles."""
        e = self.raw("embeddings")
        at = lambda k: F.abs(F.get("embedding", F.lit(k)).cast("double"))
        return e.select("vec_id", at(0).alias("x"), at(1).alias("y"), at(2).alias("w"), at(3).alias("h"))


def letter_of(number: Column) -> Column:
    """The answer letters of the warehouse: A, N or R."""
    return F.get(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (number % 3).cast("int"))


#: The same views for DuckDB, to stand in front of a query.
SQL_VIEWS = """
WITH users AS (SELECT c_custkey AS user_id, c_name AS name, c_mktsegment AS segment FROM customer),
attempts AS (SELECT o_orderkey AS attempt_id, o_custkey AS user_id, substr(o_orderpriority, 1, 1)::INTEGER AS test_id,
  CASE WHEN o_orderstatus = 'O' THEN 'STARTED' ELSE 'COMPLETED' END AS status, o_orderdate AS started_at,
  CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 7 + 1)::INTEGER END AS scope_part, o_totalprice AS score FROM orders),
tests AS (SELECT DISTINCT substr(o_orderpriority, 1, 1)::INTEGER AS test_id, o_orderpriority AS title, substr(o_orderpriority, 1, 1)::INTEGER <= 3 AS published FROM orders),
questions AS (SELECT p_partkey AS question_id, (p_partkey % 5 + 1)::INTEGER AS test_id, (p_partkey % 7 + 1)::INTEGER AS part_number, (p_partkey % 200 + 1)::INTEGER AS question_number,
  ['A', 'N', 'R'][p_partkey % 3 + 1] AS correct, p_brand AS group_name, p_name AS question_text, p_type AS passage, p_size AS size FROM part),
answers AS (SELECT l_orderkey AS attempt_id, l_partkey AS question_id, l_returnflag AS selected, l_shipdate AS v1, l_linenumber AS v2, l_suppkey AS v3, l_extendedprice AS v4 FROM lineitem),
latest AS (SELECT attempt_id, question_id, selected FROM answers QUALIFY row_number() OVER (PARTITION BY attempt_id, question_id ORDER BY v1 DESC, v2 DESC, v3 DESC, v4 DESC) = 1),
words AS (SELECT event_id AS word_id, user_id, event_type AS word, ts AS created_at, value, props FROM events),
boxes AS (SELECT vec_id, abs(embedding[1]::DOUBLE) AS x, abs(embedding[2]::DOUBLE) AS y, abs(embedding[3]::DOUBLE) AS w, abs(embedding[4]::DOUBLE) AS h FROM embeddings)
"""

"""What is missing: expected numbers, gaps and islands, counts per part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizmill.functions.numbers import part_of_number
from quizmill.model import PART_RANGES


def parts_table(spark: SparkSession) -> DataFrame:
    """The fixed seven parts: part_number, first, last."""
    return spark.createDataFrame([(p, a, b) for p, (a, b, _) in PART_RANGES.items()], "part_number int, first int, last int")


def missing_numbers(found: DataFrame, key: str) -> DataFrame:
    """(key, part_number, question_number) expected in a part but not among ``found`` (key, question_number).

    One aggregate: the numbers of a key become an array (200 at most), and the expected ones not in it are exploded.
    """
    seen = found.groupBy(key).agg(F.collect_set("question_number").alias("seen"))
    last = max(b for _, b, _ in PART_RANGES.values())
    rows = seen.select(key, F.explode(F.array_except(F.sequence(F.lit(1), F.lit(last)), "seen")).alias("question_number"))
    return rows.select(key, part_of_number(F.col("question_number")).alias("part_number"), "question_number")


def islands(numbers: DataFrame, key: str, number: str) -> DataFrame:
    """(key, ranges): the numbers of each key as ``a-b, c`` in rising order."""
    distinct = numbers.select(key, number).distinct()
    order = Window.partitionBy(key).orderBy(number)
    runs = distinct.withColumn("_island", F.col(number) - F.row_number().over(order))
    runs = runs.groupBy(key, "_island").agg(F.min(number).alias("a"), F.max(number).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    listed = F.array_sort(F.collect_list(F.struct("a", text.alias("t"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s["t"]), ", ").alias("ranges"))


def parse_summary(found: DataFrame, spark: SparkSession) -> DataFrame:
    """Per part: distinct numbers found, numbers expected, and what is missing as ranges (— if nothing)."""
    parts = parts_table(spark)
    inside = found.withColumn("part_number", part_of_number(F.col("question_number"))).where("part_number is not null")
    counts = inside.groupBy("part_number").agg(F.countDistinct("question_number").alias("parsed"))
    expected = parts.select("part_number", F.explode(F.sequence("first", "last")).alias("question_number"))
    missing = islands(expected.join(found.select("question_number").distinct(), "question_number", "left_anti"), "part_number", "question_number")
    rows = parts.join(counts, "part_number", "left").join(missing, "part_number", "left")
    return rows.select(
        "part_number", F.coalesce("parsed", F.lit(0)).alias("parsed"), (F.col("last") - F.col("first") + 1).cast("long").alias("expected"), F.coalesce("ranges", F.lit("—")).alias("missing"),
    )

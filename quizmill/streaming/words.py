"""Word events as a stream: deduplicated counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def word_counts(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, word, n, users): counts of distinct events per window and word; later than ``late`` is dropped when streaming."""
    rows = events.withWatermark("created_at", late) if events.isStreaming else events
    windowed = rows.groupBy(F.window("created_at", every).alias("w"), "word")
    return windowed.agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "word", "n", "users")


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream, a few files per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(folder)

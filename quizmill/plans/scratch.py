"""Intermediate tables in the shared folder that the session names, so that what they cost is paid once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "spark.quizmill.scratch"


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a session with a local master and without one gets a new folder."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_OWN, None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="quizmill-")
        spark.conf.set(_OWN, there)
    return there.rstrip("/")


def new_name() -> str:
    return uuid.uuid4().hex


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again: later readers share the work, and a lost executor costs its own tasks only."""
    path = f"{folder(df.sparkSession)}/{name}-{new_name()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

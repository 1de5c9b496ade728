"""Helpers that several corpus operators share.

Tables between jobs are written to the folder named by ``spark.checkpoint.dir``
(shared by driver and executors), so a lost executor costs only its own tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of all contracts: space and the ASCII controls 9 to 13.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one numpy step handles at once; bounds a task's memory.
CHUNK_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in a local session without one, a new folder."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quizmill.shared", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    there = "file://" + tempfile.mkdtemp(prefix="quizmill-")
    spark.conf.set("spark.quizmill.shared", there)
    return there


def _run_folder(spark: SparkSession) -> str:
    """This application's folder, with the file system's scheme, so that tasks without Hadoop's defaults find it too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quizmill-{spark.sparkContext.applicationId}")
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below this application's folder in the shared folder."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_written(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; results not yet read are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again (cuts the lineage)."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between the jobs of one operator, each deleted as soon as no job needs it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.paths = spark, new_path(spark, name), {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once as Parquet and read again; a repeated name gets a number behind it."""
        own = name if name not in self.paths else next(k for n in range(1, len(self.paths) + 2) if (k := f"{name}.{n}") not in self.paths)
        self.paths[own] = path = f"{self.folder}/{own}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tables(self, start: str = "") -> list[str]:
        return [name for name in self.paths if name.startswith(start)]

    def drop(self, *names: str, but: tuple[str, ...] | None = None) -> None:
        """Deletes the tables named, or all but some; whoever reads them must be done."""
        for name in names if but is None else [x for x in self.paths if x not in but]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``dropped`` (column doc_id); rows without doc_id stay.

    The ids are written first, so that Spark knows their size: it sends few ids
    to the tasks and shuffles for many.
    """
    ids = written(dropped.select(F.col("doc_id").cast("long").alias("_dropped")).where("_dropped is not null"), "dropped")
    return docs.join(ids, docs["doc_id"] == ids["_dropped"], "left_anti")


#: Bits of a filter that tasks get: 8 MB at most.
FILTER_BITS_MOST = 1 << 26


def filter_of(hashes: DataFrame, count: int) -> tuple[int, bytes]:
    """(bits, filled) of a one-hash filter of bounded size over ``count`` values (the only column, long), built by partial aggregates."""
    bits = 1 << 16
    while bits < min(64 * count, FILTER_BITS_MOST):
        bits *= 2
    slots = hashes.select(F.pmod(F.col(hashes.columns[0]), F.lit(bits)).alias("slot"))
    pieces = slots.groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bits")).collect()  # a row per 4 KB
    out = bytearray(bits // 8)
    for r in pieces:
        a = (r["k"] - 1) * 4096
        out[a : a + 4096] = bytes(r["bits"])[: bits // 8 - a]
    return bits, bytes(out)


def in_filter(filled: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (filled[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def passes(filled):
    """A condition on a slot column: its bit is set in the broadcast filter."""
    return F.pandas_udf(lambda slot: pd.Series(in_filter(np.frombuffer(filled.value, np.uint8), slot.to_numpy())), "boolean")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of an Arrow string array; nulls are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, offsets, data = array.buffers()
    if offsets is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def blocks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets from 0, bytes) of runs of whole texts of about ``limit`` bytes."""
    at, raw = buffers(array)
    row, rows = 0, len(at) - 1
    while row < rows:
        end = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, at[row : end + 1] - at[row], raw[at[row] : at[end]]
        row = end


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) over uint64 values."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

"""Uploaded files: bytes by key, MIME types, and documents as text through an optional extractor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.functions import text as T

# MIME types by extension.
MIME_TYPES = {".pdf": "application/pdf", ".mp3": "audio/mpeg", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".txt": "text/plain"}


def files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content, length, modificationTime) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)


def mime_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(T.extension(name))), F.lit("application/octet-stream"))


def as_base64(content: Column) -> Column:
    """Base64 in one line; Spark breaks it behind every 76 characters."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def texts(documents: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, page, text): pages of each file by ``extract``, which turns bytes into page texts; unreadable files give no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, k, page) for k, page in enumerate(extract(bytes(content)))]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return documents.select("path", "content").mapInPandas(run, "path string, page int, text string")

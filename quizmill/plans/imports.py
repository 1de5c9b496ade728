"""Direct imports: named files of a test, its job, and its questions, as one new version of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizmill.operators.state import replaced
from quizmill.sources import versions

# Upload fields with their kinds, where a kind's object lies, and how many files an import needs.
FIELDS = {"examPdf": "EXAM_PDF", "keyLcPdf": "KEY_LC_PDF", "keyRcImage": "KEY_RC_IMAGE", "audioMp3": "AUDIO_MP3"}
PLACES = {"EXAM_PDF": ("exams", "exam"), "KEY_LC_PDF": ("answers", "key-lc"), "KEY_RC_IMAGE": ("images", "key-rc"), "AUDIO_MP3": ("audio", "listening")}
LEAST_FILES = 3


def _choice(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def file_key(exam: Column, test: Column, kind: Column, name: Column) -> Column:
    """The object key of an uploaded file; without an extension of its own it ends in .bin."""
    ending = F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1))
    folder, stem = (_choice({k: p[n] for k, p in PLACES.items()}, kind) for n in (0, 1))
    return F.concat(folder, F.lit("/"), exam, F.lit("/"), test, F.lit("/"), stem, F.when(ending == "", ".bin").otherwise(ending))


def accepted_files(uploads: DataFrame, exam: str = "toeic") -> DataFrame:
    """(test_id, kind, name, key, files, enough): one file for each known field of a test, the first by its place, and whether they are enough.

    ``uploads`` has test_id, field, place and name; other fields are left out.
    """
    rows = uploads.withColumn("kind", _choice(FIELDS, F.col("field"))).where("kind is not null")
    rows = rows.groupBy("test_id", "kind").agg(F.min_by("name", "place").alias("name"))
    rows = rows.withColumn("key", file_key(F.lit(exam), F.col("test_id").cast("string"), F.col("kind"), F.col("name")))
    return rows.withColumn("files", F.count("*").over(Window.partitionBy("test_id"))).withColumn("enough", F.col("files") >= LEAST_FILES)


def direct_import(spark: SparkSession, folder: str, uploads: DataFrame, parsed: DataFrame) -> DataFrame:
    """Imports ``parsed`` questions (test_id, part_number, question_number, …) of every test whose files are enough; returns the jobs.

    Files, jobs (test_id, status, files, total_questions, parts) and questions change together, as one
    version below ``folder``. A test's questions replace those it had; a test without enough files,
    or without questions, is refused and keeps its own.
    """
    files = accepted_files(uploads)
    of_test = files.groupBy("test_id").agg(F.max("files").alias("files"), F.bool_or("enough").alias("enough"))
    counts = parsed.groupBy("test_id", "part_number").agg(F.count("*").alias("n"))
    counts = counts.groupBy("test_id").agg(F.sum("n").alias("total_questions"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("part_number", "n")))).alias("parts"))
    every = uploads.select("test_id").distinct()
    jobs = every.join(of_test, "test_id", "left").join(counts, "test_id", "left")
    done = F.coalesce("enough", F.lit(False)) & F.col("total_questions").isNotNull()
    jobs = jobs.select("test_id", F.when(done, "DONE").otherwise("REFUSED").alias("status"), F.coalesce("files", F.lit(0)).alias("files"), F.when(done, F.col("total_questions")).alias("total_questions"), F.when(done, F.col("parts")).alias("parts"))
    good = jobs.where("status = 'DONE'").select("test_id")
    fresh = parsed.join(good, "test_id", "left_semi")
    before = versions.tables_of(spark, versions.current(spark, folder))
    questions = replaced(spark.read.parquet(before["questions"]), fresh, ["test_id"]) if "questions" in before else fresh
    kept = files.join(good, "test_id", "left_semi").select("test_id", "kind", "name", "key")
    all_files = spark.read.parquet(before["files"]).unionByName(kept) if "files" in before else kept
    versions.write_version(spark, folder, {"files": all_files, "jobs": jobs, "questions": questions}, {"questions": {"every question has a number": F.count_if(F.col("question_number").isNull()) == 0}})
    return versions.read(spark, folder, "jobs")

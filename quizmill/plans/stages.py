"""Step states of import jobs: a log of (job_id, step, ordinal, status), newest state wins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = ("classify", "extract", "parse", "normalize", "assets", "save_db")


def job_summary(states: DataFrame) -> DataFrame:
    """Per job: steps done, steps skipped, and the last failed step in pipeline order (``classify`` if none)."""
    failed = F.max_by(F.when(F.col("status") == "failed", F.col("step")), F.when(F.col("status") == "failed", F.col("ordinal")))
    return states.groupBy("job_id").agg(
        F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.coalesce(failed, F.lit("classify")).alias("last_failed"),
    )


def resumable(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("FAILED", "IMPORTING"))


def job_view(jobs: DataFrame, files: DataFrame, drafts: DataFrame, tests: DataFrame) -> DataFrame:
    """Every job with its files (an array in order of their names), its draft and its test; both may be missing.

    ``jobs`` has job_id, draft_id and test_id, ``files`` job_id, name and role; ``drafts`` and
    ``tests`` their ids and what is to be shown of them. Files are gathered per job before the join.
    """
    of_job = files.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("name", "role"))).alias("files"))
    rows = jobs.join(of_job, "job_id", "left").join(drafts, "draft_id", "left").join(tests, "test_id", "left")
    return rows.withColumn("files", F.coalesce("files", F.array().cast(of_job.schema["files"].dataType)))


def to_redo(states: DataFrame, counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Done steps whose count differs from the expected one, per job; they run again, and so does saving."""
    off = states.where("status = 'done'").join(counts, ["job_id", "step"]).join(expected, "step").where("found <> expected").select("job_id", "step")
    return off.unionByName(off.select("job_id").distinct().withColumn("step", F.lit("save_db"))).distinct()


EVENTS = "job_id string, step string, at timestamp, status string, message string, partial string"


class PartialOutput(Exception):
    """A step failed, but part of its text came; a later run may continue from it."""

    def __init__(self, message: str, partial: str):
        super().__init__(message)
        self.partial = partial


def record(spark: SparkSession, folder: str, job: str, step: str, status: str, message: str | None = None, partial: str | None = None) -> None:
    """Appends one event to the log of all jobs below the folder."""
    row = [(job, step, datetime.now(UTC), status, message, partial)]
    spark.createDataFrame(row, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/_events")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The log of all jobs; empty before the first event."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_events")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(EVENTS).parquet(f"{folder}/_events") if there else spark.createDataFrame([], EVENTS)


def states(spark: SparkSession, folder: str) -> DataFrame:
    """(job_id, step, status, message, partial, at): the newest event of every step."""
    newest = F.max_by(F.struct("status", "message", "partial", "at"), "at").alias("e")
    return events(spark, folder).groupBy("job_id", "step").agg(newest).select("job_id", "step", "e.*")


def chunks(name: str, step: Callable[[SparkSession, dict, tuple[int, int]], DataFrame], ranges: list[tuple[int, int]]) -> list[tuple[str, Callable[[SparkSession, dict], DataFrame]]]:
    """A step cut into ranges, each with a checkpoint of its own, and the step itself, which unites them."""
    each = [(f"{name}_{a}_{b}", lambda spark, results, span=(a, b): step(spark, results, span)) for a, b in ranges]
    names = [n for n, _ in each]
    return [*each, (name, lambda spark, results: reduce(DataFrame.unionByName, [results[n] for n in names]))]


class RowsFailed(Exception):
    """Some rows of a step failed; those that are done, and what the others produced, are kept."""


class RowStep:
    """A step whose work is done row by row in tasks, and that goes on where it failed.

    ``rows`` (spark, results) gives the rows, one for each ``key``; ``work`` (row, partial)
    gives a row's result as a dict of ``schema``, where partial is the text that
    came before its last failure, or None. What it raises is kept as the row's message and,
    if it has one, ``partial`` text; other rows are not affected.
    """

    def __init__(self, rows: Callable[[SparkSession, dict], DataFrame], key: str, work: Callable[[dict, str | None], dict], schema: str):
        self.rows, self.key, self.work, self.schema = rows, key, work, schema

    def outcomes(self, rows: DataFrame) -> DataFrame:
        """(key, status, result, message, partial) of every row (columns of ``rows`` and _partial)."""
        key, work, kind = self.key, self.work, rows.schema[self.key].dataType.simpleString()

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = []
                for row in pdf.to_dict("records"):
                    partial = row.pop("_partial")
                    try:
                        out.append((row[key], "done", work(row, partial), None, None))
                    except Exception as error:  # noqa: BLE001
                        out.append((row[key], "failed", None, str(error)[:2_000], getattr(error, "partial", None) or partial))
                yield pd.DataFrame(out, columns=[key, "status", "result", "message", "partial"])

        return rows.mapInPandas(run, f"{key} {kind}, status string, result struct<{self.schema}>, message string, partial string")

    def run(self, spark: SparkSession, path: str, results: dict) -> DataFrame:
        """One attempt over the rows that are not done; the results of all attempts, or RowsFailed."""
        rows = self.rows(spark, results)
        before = attempts(spark, path)
        if before:
            kept = reduce(DataFrame.unionByName, [spark.read.parquet(p).withColumn("_n", F.lit(n)) for n, p in enumerate(before)])
            last = kept.groupBy(self.key).agg(F.max_by(F.struct("status", "partial"), "_n").alias("_last"))
            rows = rows.join(last, self.key, "left").where("_last is null or _last.status <> 'done'").withColumn("_partial", F.col("_last.partial")).drop("_last")
        else:
            rows = rows.withColumn("_partial", F.lit(None).cast("string"))
        now = f"{path}-rows-{len(before):04d}"
        self.outcomes(rows).write.mode("overwrite").parquet(now)
        bad = spark.read.parquet(now).where("status = 'failed'").agg(F.count("*").alias("n"), F.min("message").alias("message")).first()
        if bad["n"]:
            raise RowsFailed(f"{bad['n']} rows failed, as: {bad['message']}")
        done = reduce(DataFrame.unionByName, [spark.read.parquet(p) for p in (*before, now)])
        return done.where("status = 'done'").select(self.key, "result.*")


def attempts(spark: SparkSession, path: str) -> list[str]:
    """The attempts of a row step that were written whole, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-rows-*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(s.getPath().getParent().toString() for s in found or [])


def run_steps(spark: SparkSession, folder: str, job: str, steps: list[tuple[str, Callable[[SparkSession, dict], DataFrame] | RowStep]]) -> dict[str, str]:
    """Runs the steps in order, each result written under the job's folder; finished steps are not run again.

    A row step keeps the rows that are done in a failed attempt, also those of tasks
    that ended before others failed, and the next run asks for the rest only.

    A step counts as finished when its folder has its success marker, which the
    writer leaves last, so that an interrupted step runs again as a whole. Every
    run, skip, end and failure is an event; a failure keeps its message and what
    text came, and is raised again.
    """
    out, results = {}, {}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name, step in steps:
        path = f"{folder}/{job}/{name}"
        marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if marker.getFileSystem(conf).exists(marker):
            out[name] = "skipped"
            record(spark, folder, job, name, "skipped")
        else:
            record(spark, folder, job, name, "running")
            try:
                result = step.run(spark, path, results) if isinstance(step, RowStep) else step(spark, results)
                result.write.mode("overwrite").parquet(path)
            except Exception as error:
                record(spark, folder, job, name, "failed", str(error)[:2_000], getattr(error, "partial", None))
                raise
            out[name] = "done"
            record(spark, folder, job, name, "done")
        results[name] = spark.read.parquet(path)
    return out

"""Several tables that change together: new tables are written whole, then one pointer is switched.

A version lists where each of its tables lies, so that a table left out costs nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER, TABLES = "CURRENT", "TABLES"


class Moved(Exception):
    """Another writer has switched since the version that this one builds on."""


class GuardFailed(Exception):
    """A condition on the rows written does not hold."""


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    at, system = _file_system(spark, path)
    out = system.create(at)
    out.write(bytearray(text.encode()))
    out.close()


def _rename(spark: SparkSession, old: str, new: str, over: bool) -> None:
    """A move that appears whole; without ``over`` it fails if the target is there."""
    at, _ = _file_system(spark, old)
    to, _ = _file_system(spark, new)
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE if over else hadoop.Options.Rename.NONE
    context.rename(context.makeQualified(at), context.makeQualified(to), options)


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the version that readers see; null before the first."""
    at, system = _file_system(spark, f"{folder}/{POINTER}")
    if not system.exists(at):
        return None
    return f"{folder}/{spark.read.text(f'{folder}/{POINTER}').first()[0]}"


def tables_of(spark: SparkSession, version: str | None) -> dict[str, str]:
    """A version's tables and where they lie; none before the first version."""
    return json.loads(spark.read.text(f"{version}/{TABLES}").first()[0]) if version else {}


def write_version(spark: SparkSession, folder: str, tables: dict[str, DataFrame], guards: dict[str, dict[str, Column]] | None = None, base: str | None = None) -> str:
    """Writes the tables given and switches to a version with them; the others stay where they lie.

    ``guards`` has conditions over a table's rows (boolean aggregates, by name), taken while
    it is written; if one does not hold, the version before stays, and GuardFailed names it.
    The version builds on ``base`` (the current one, by default); if another writer has
    switched since, Moved is raised and nothing changes. Readers see the old version or the
    new one and never a part of it.
    """
    name, before = f"v-{uuid.uuid4().hex}", base or current(spark, folder)
    seen, places = {}, tables_of(spark, before)
    for table, rows in tables.items():
        if guards and table in guards:
            seen[table] = Observation(f"{table}-{name}")
            rows = rows.observe(seen[table], *[condition.alias(k) for k, condition in guards[table].items()])
        places[table] = f"{folder}/{name}/{table}"
        rows.write.parquet(places[table])
    failed = [f"{table}: {k}" for table, observed in seen.items() for k, holds in observed.get.items() if not holds]
    if failed:
        _remove(spark, f"{folder}/{name}")
        raise GuardFailed("; ".join(failed))
    _put(spark, f"{folder}/{name}/{TABLES}", json.dumps(places))
    # One version may follow another: the first writer to claim that place wins.
    was = before.rpartition("/")[2] if before else "none"
    _put(spark, f"{folder}/.claim-{name}", name)
    try:
        if current(spark, folder) != before:
            raise Moved(f"{folder} is no longer at {was}")
        _rename(spark, f"{folder}/.claim-{name}", f"{folder}/AFTER-{was}", False)
    except Exception as error:
        _remove(spark, f"{folder}/{name}")
        _remove(spark, f"{folder}/.claim-{name}")
        raise error if isinstance(error, Moved) else Moved(f"another version follows {was} in {folder}") from error
    _put(spark, f"{folder}/.{POINTER}-{name}", name)
    _rename(spark, f"{folder}/.{POINTER}-{name}", f"{folder}/{POINTER}", True)
    return f"{folder}/{name}"


def _remove(spark: SparkSession, path: str) -> None:
    at, system = _file_system(spark, path)
    system.delete(at, True)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of the current version."""
    version = current(spark, folder)
    if version is None:
        raise ValueError(f"no version below {folder}")
    return spark.read.parquet(tables_of(spark, version)[table])


def put_objects(objects: DataFrame, folder: str) -> DataFrame:
    """(key, size): writes every row (key, content) as the file of its key below ``folder``; writing a key again replaces it.

    A file appears whole, by a move; of rows with one key either stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            sizes = []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = f"{root}/{key}"
                store.create_dir(at.rpartition("/")[0])
                fresh = f"{at}.{uuid.uuid4().hex}"
                with store.open_output_stream(fresh) as out:
                    out.write(content or b"")
                store.move(fresh, at)
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["key", "size"])

    return objects.select("key", F.col("content").cast("binary")).mapInArrow(run, "key string, size long")


def seed_if_empty(spark: SparkSession, folder: str) -> bool:
    """Writes the starting tables (two users, a published test with seven parts of one question each) unless there are users."""
    if current(spark, folder) and not read(spark, folder, "users").isEmpty():
        return False
    numbers = spark.range(1, 8).select(F.col("id").cast("int").alias("n"))
    tables = {
        "users": spark.createDataFrame([(1, "admin", "ADMIN"), (2, "student", "USER")], "user_id long, name string, role string"),
        "tests": spark.createDataFrame([(1, "Sample test", True)], "test_id int, title string, published boolean"),
        "parts": numbers.select(F.lit(1).alias("test_id"), F.col("n").alias("part_number")),
        "questions": numbers.select(
            F.lit(1).alias("test_id"), F.col("n").alias("part_number"), F.col("n").alias("question_number"), F.concat(F.lit("Sample question of part "), F.col("n").cast("string")).alias("question_text"),
            F.transform(F.array(*map(F.lit, "ABCD")), lambda c: F.struct(c.alias("letter"), F.concat(F.lit("Option "), c).alias("text"))).alias("options"), F.lit("A").alias("correct"),
        ),
    }
    write_version(spark, folder, tables)
    return True

"""Keyed tables kept as append logs: latest-wins views and the writes that lead to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key. A partial aggregate, so a hot key shrinks before the shuffle."""
    rest = [c for c in log.columns if c not in (*keys, version)]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    return newest.select(*keys, "_row.*")


def upserted(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows after the changes; applying the same changes twice changes nothing."""
    return latest(current.unionByName(changes), keys, version)


def live(log: DataFrame, keys: list[str], version: str, op: str = "op") -> DataFrame:
    """The newest row of each key unless that row is a delete."""
    return latest(log, keys, version).where(F.col(op) != "delete").drop(op)


def or_keep(new: Column, old: Column) -> Column:
    """New unless null or empty."""
    return F.coalesce(F.when(new != "", new), old)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascade of a delete: rows whose parent is gone go too."""
    return rows.join(gone.select(key), key, "left_anti")


def detached(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Set-null of a delete: rows stay, their reference to a gone parent becomes null."""
    marked = gone.select(F.col(key).alias("_gone")).distinct()
    joined = rows.join(marked, rows[key] == marked["_gone"], "left")
    return joined.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def replaced(rows: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Replace-import: every key that ``fresh`` brings loses its old rows first."""
    return rows.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)

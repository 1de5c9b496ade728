"""Connected components over DataFrames: forests of bounded runs of links, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import Scratch

#: Links that one task contracts at once.
RUN = 200_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of links (u, v) as links of every node with the smallest node that it reaches within the run."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    def stars() -> pa.RecordBatch:
        found = [(x, top(x)) for x in list(root)]
        found = [(x, r) for x, r in found if x != r]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["u", "v"])

    held = 0
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            root[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held > RUN:
            yield stars()
            held = 0
    yield stars()


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.written(both.groupBy("u").agg(F.min("v").alias("m")), "cc-large").select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    least = scratch.written(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Every node has one link to a smaller node, or is one that others link to."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of the undirected ``links`` (u, v); label is the smallest node reachable."""
    forest = links.where("u <> v").select("u", "v").mapInArrow(_contracted, "u long, v long").distinct()
    edges, old = scratch.written(forest, "cc-edges"), []
    while True:
        done = _are_stars(edges)
        scratch.drop(*old)
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        old = scratch.tables("cc-")
        edges = scratch.written(_small_star(scratch.written(_large_star(edges, scratch), "cc-wide"), scratch), "cc-edges")

"""Operator 4, exact top-k search: a Voronoi kNN join by inner product.

Vectors are scaled to integers and assigned to the nearest pivot; there are about
as many pivots as the root of the number of vectors. Every query first meets a
bounded sample of its own cell and one of the whole table, whose k-th best score
bounds its result from below. Cells' summaries (number of queries, their radius,
the least bound) are merged into query groups around a part of the pivots. For a
group with centre p, radius r and least bound t a vector x can matter only if
``p.x + r |x| >= t``, as ``q.x <= p.x + |q - p| |x|``; so a vector is replicated
only to the groups that need it. How coarse the groups are is chosen by the copies
and products that a sample of the vectors foretells: many groups where cells are
tight, few where the bounds exclude little. Groups are cut into tiles of bounded
size on both sides, solved by matrix products, and a window merges the tiles'
best rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import Scratch, mixed, table

#: Bytes of all pivots at most, as doubles.
PIVOT_BYTES = 16 << 20
#: Vectors in the sample of a cell and in that of the table, at most.
CELL_SAMPLE, SAMPLE = 1_024, 2_048
#: Queries and vectors of a tile.
QUERY_BLOCK, BLOCK = 4_096, 8_192
SCALE = 64
#: Components from here on have squares that are no finite doubles.
LARGEST = 1e140
#: Cost of one copied row against one product of two vectors, for the choice of groups.
COPY_COST = 100

_ROUNDING = 1e-6


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) of every vector, padded with zeros to ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    rows = np.repeat(np.arange(len(column)), sizes)
    places = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, places] = np.floor(SCALE * values)
    return out


def _unpacked(vectors, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1)


def _assign(pivots: np.ndarray, kind: np.dtype):
    own = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                x = _matrix(part.column(1), pivots.shape[1])
                square = (x**2).sum(axis=1)
                apart = np.maximum(square[:, None] + own[None, :] - 2 * x @ pivots.T, 0)
                cell = apart.argmin(axis=1)
                away = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(cell.astype(np.int32)), pa.array(away), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary())],
                    names=["vec_id", "cell", "apart", "vector"],
                )

    return run


def _largest(x: np.ndarray) -> np.ndarray:
    return np.abs(x.astype(np.float64)).max(axis=1, initial=0)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; those beyond a long are the largest or the smallest long.

    Rows with components so large that doubles or longs may not hold their products are multiplied apart.
    """
    most_q, most_x = _largest(q), _largest(x)
    if q.shape[1] * most_q.max(initial=0) * most_x.max(initial=0) < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if q.shape[1] * most_q.max(initial=0) * most_x.max(initial=0) < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    fits = (2**61 / q.shape[1]) ** 0.5
    small_q, small_x = most_q < fits, most_x < fits
    out = np.zeros((len(q), len(x)), np.int64)
    if small_q.any() and small_x.any():
        out[np.ix_(small_q, small_x)] = _scores(q[small_q], x[small_x])
    for rows, columns in ((~small_q, np.ones(len(x), bool)), (small_q, ~small_x)):
        if rows.any() and columns.any():
            wide = _integers(q[rows]) @ _integers(x[columns]).T
            out[np.ix_(rows, columns)] = np.clip(wide, np.iinfo(np.int64).min, np.iinfo(np.int64).max).astype(np.int64)
    return out


def _integers(x: np.ndarray) -> np.ndarray:
    """Python's integers, of any size."""
    return np.frompyfunc(int, 1, 1)(x)


def _bounded(k: int, kind: np.dtype, sample_ids: np.ndarray, sample: np.ndarray):
    """Queries with the k-th best score among their cell's sample and the table's; null if there are fewer than k others."""

    def run(queries: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(queries):
            return pd.DataFrame({"query_id": [], "cell": [], "apart": [], "vector": [], "least": []})
        ids, one = np.unique(np.concatenate([near["vec_id"].to_numpy(np.int64), sample_ids]), return_index=True)
        x = np.concatenate([_unpacked(near["vector"], kind) if len(near) else sample[:0], sample])[one]
        least: list[int | None] = []
        for at in range(0, len(queries), 512):
            part = queries.iloc[at : at + 512]
            scores = _scores(_unpacked(part["vector"], kind), x)
            others = part["query_id"].to_numpy(np.int64)[:, None] != ids[None, :]
            scores = np.where(others, scores, np.iinfo(np.int64).min)
            enough = others.sum(axis=1) >= k
            bars = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.zeros(len(part), np.int64)
            least += [int(v) if e else None for v, e in zip(bars, enough, strict=True)]
        return queries[["query_id", "cell", "apart", "vector"]].assign(least=pd.array(least, "Int64"))

    return run


class Groups:
    """Query groups: cells merged around the first pivots, with centre, radius and least bound of each."""

    def __init__(self, pivots: np.ndarray, cells: list, count: int):
        """``cells`` has (cell, number of queries, their radius, least bound or None)."""
        where = np.array([c[0] for c in cells], np.int64)
        centres, at = pivots[:count], pivots[where]
        apart = np.sqrt(np.maximum((at**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * at @ centres.T, 0))
        group = apart.argmin(axis=1)
        used, group = np.unique(group, return_inverse=True)
        self.centres, n = centres[used], len(used)
        self.of_cell = dict(zip(where.tolist(), group.tolist(), strict=True))
        self.queries, self.radius, self.least = np.zeros(n, np.int64), np.zeros(n), np.full(n, np.inf)
        np.add.at(self.queries, group, [c[1] for c in cells])
        np.maximum.at(self.radius, group, np.sqrt(((at - centres[used][group]) ** 2).sum(axis=1)) + np.array([c[2] for c in cells]))
        np.minimum.at(self.least, group, [-np.inf if c[3] is None or c[3] == np.iinfo(np.int64).min else c[3] for c in cells])
        self.blocks = -(-self.queries // QUERY_BLOCK)

    def needs(self, x: np.ndarray) -> np.ndarray:
        """Whether a group (column) may need a vector (row)."""
        length = np.sqrt((x**2).sum(axis=1))[:, None]
        most = x @ self.centres.T + length * self.radius[None, :]
        inexact = _ROUNDING * (1 + np.abs(most)) + _ROUNDING**2 * length * np.sqrt((self.centres**2).sum(axis=1))[None, :]
        return most + inexact >= self.least[None, :]

    def cost(self, x: np.ndarray) -> float:
        share = self.needs(x).mean(axis=0)
        return float((share * (COPY_COST * self.blocks + self.queries)).sum())


def _needed(groups: Groups, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(groups.queries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                total += groups.needs(_unpacked(batch.column(0).slice(at, 1_000).to_pylist(), kind).astype(np.float64)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["g", "n"])

    return run


def _replicated(groups: Groups, parts: np.ndarray, kind: np.dtype):
    """A row of a vector for every block of queries of every group that may need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                ids, vectors = batch.column(0).slice(at, 1_000), batch.column(1).slice(at, 1_000)
                row, g = np.nonzero(groups.needs(_unpacked(vectors.to_pylist(), kind).astype(np.float64)))
                row, g = np.repeat(row, groups.blocks[g]), np.repeat(g, groups.blocks[g])
                first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])))) if len(row) else row
                block = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                part = mixed(ids.to_numpy().astype(np.int64).view(np.uint64))[row] % parts[g].astype(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32)), ids.take(pa.array(row)), vectors.take(pa.array(row))],
                    names=["g", "b", "d", "vec_id", "vector"],
                )

    return run


def _solve_tile(k: int, kind: np.dtype):
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})]
        x, ids = (_unpacked(data["vector"], kind) if len(data) else None), data["vec_id"].to_numpy(np.int64)
        lowest = np.iinfo(np.int64).min
        for at in range(0, len(queries) if len(data) else 0, 512):
            part = queries.iloc[at : at + 512]
            scores, own = _scores(_unpacked(part["vector"], kind), x), part["query_id"].to_numpy(np.int64)
            bar = np.array([lowest if pd.isna(v) else int(v) for v in part["least"]], np.int64)
            if len(ids) > k + 1:
                bar = np.maximum(bar, np.partition(scores, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1])
            row, col = np.nonzero((scores >= bar[:, None]) & (own[:, None] != ids[None, :]))
            score, vec = scores[row, col], ids[col]
            order = np.lexsort((vec, -score, row))
            row, score, vec = row[order], score[order], vec[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append(pd.DataFrame({"query_id": own[row[keep]], "vec_id": vec[keep], "score": score[keep]}))
        return pd.concat(found, ignore_index=True)

    return run


def _chosen(pivots: np.ndarray, cells: list, sample: np.ndarray) -> Groups:
    """The groups with the least cost, from one around all pivots to one around each."""
    best, count = None, 1
    while True:
        groups = Groups(pivots, cells, min(count, len(pivots)))
        if best is None or groups.cost(sample) < best.cost(sample):
            best = groups
        if count >= len(pivots):
            return best
        count *= 4


def top_k(vectors: DataFrame, is_query, k: int = 20, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k other rows of highest integer inner product.

    ``vectors`` needs vec_id (unique) and embedding; other columns are ignored.
    ``is_query`` is a condition on vec_id. Rows without vec_id, null vectors and
    vectors with null or non-finite components take no part; shorter vectors,
    empty ones too, count as padded with zeros to the longest, which must fit a
    task a few thousand times over. Ties go to the smaller vec_id; equal vectors
    are rows of their own. A query with fewer other rows gets them all. No rows
    give no rows. Scaled components must fit 53 bits and scores a long.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "knn")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(LARGEST)) & ~F.isnan(x))
    valid = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    largest = F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))
    found = valid.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), largest.alias("largest")).first()
    if not found["n"] or not found["dim"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, scale = found["dim"], SCALE * (found["largest"] or 0) + 1
    kind = np.dtype(next((t for t in ("i1", "i2", "i4", "i8") if scale < np.iinfo(t).max), "f8"))
    count = min(pivots or max(16, int(found["n"] ** 0.5)), max(1, PIVOT_BYTES // (8 * dim)))
    drawn = valid.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id")
    chosen = _matrix(drawn.limit(count).select("embedding").toArrow()["embedding"], dim)  # at most PIVOT_BYTES
    points = chosen[np.sort(np.unique(chosen, axis=0, return_index=True)[1])]
    data = scratch.written(valid.mapInArrow(_assign(points, kind), "vec_id long, cell int, apart double, vector binary"), "cells")
    queries = scratch.written(data.where(is_query).select(F.col("vec_id").alias("query_id"), "cell", "apart", "vector"), "queries")
    # The queries' bounds, from samples.
    by_hash = Window.partitionBy("cell").orderBy(F.xxhash64("vec_id", F.lit(4)), "vec_id")
    near = scratch.written(data.withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= CELL_SAMPLE).select("cell", "vec_id", "vector"), "samples")
    some = data.orderBy(F.xxhash64("vec_id", F.lit(4)), "vec_id").limit(min(SAMPLE, max(2 * k + 2, PIVOT_BYTES // (8 * dim)))).select("vec_id", "vector").toPandas()
    sample_ids, sample = some["vec_id"].to_numpy(np.int64), _unpacked(some["vector"], kind)
    sizes = queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
    sizes = scratch.written(sizes, "sizes")
    left = queries.join(sizes, "cell").withColumn("b", F.pmod(F.xxhash64("query_id", F.lit(2)), "blocks").cast("int")).drop("blocks").groupBy("cell", "b")
    right = near.join(sizes, "cell").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").groupBy("cell", "b")
    asked = left.cogroup(right).applyInPandas(_bounded(k, kind, sample_ids, sample), "query_id long, cell int, apart double, vector binary, least long")
    asked = scratch.written(asked, "asked")
    # Query groups from the cells' summaries, and the vectors that each needs.
    unbound = F.bool_or(F.col("least").isNull())
    cells = asked.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius"), F.when(~unbound, F.min("least")).alias("least")).collect()  # a row a pivot
    if not cells:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = _chosen(points, [(r["cell"], r["n"], r["radius"], r["least"]) for r in sorted(cells)], sample.astype(np.float64))
    needed = data.select("vector").mapInArrow(_needed(groups, kind), "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()  # a row a group
    parts = np.ones(len(groups.queries), np.int64)
    for r in needed:
        parts[r["g"]] = max(1, -(-r["n"] // BLOCK))
    plan = [(cell, g, int(groups.blocks[g]), int(parts[g])) for cell, g in groups.of_cell.items()]
    plan = F.broadcast(spark.createDataFrame(plan, "cell int, g int, blocks int, parts int"))  # a row a pivot
    tiles = asked.join(plan, "cell").withColumn("b", F.pmod(F.xxhash64("query_id", F.lit(2)), "blocks").cast("int"))
    tiles = tiles.select("g", "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("d"), "query_id", "vector", "least").groupBy("g", "b", "d")
    copies = data.select("vec_id", "vector").mapInArrow(_replicated(groups, parts, kind), "g int, b int, d int, vec_id long, vector binary").groupBy("g", "b", "d")
    solved = tiles.cogroup(copies).applyInPandas(_solve_tile(k, kind), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = scratch.written(solved.withColumn("rank", rank).where(F.col("rank") <= k), "best")
    scratch.drop(but=("best",))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.z, d.z), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

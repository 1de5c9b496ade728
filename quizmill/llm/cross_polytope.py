"""Operator 11, approximate nearest neighbours: cross-polytope hashing with multiprobe tables.

A table has one or more fast pseudo-rotations (three rounds of random signs and a
Hadamard transform); a unit vector's bucket is the signed axis nearest to each of its
rotations. So that the largest inner product is the nearest vector, data get one
more component that brings all to one length (queries get 0 there). A query
probes buckets of all tables in order of the sum of its coordinates along their axes.
How many is calibrated: a bounded sample of queries meets all rows exactly, and the
number of probes is the least with which its neighbours share a probed bucket often
enough. Queries and rows of a bucket meet in tiles of bounded size, every
candidate's product is taken on the original vectors, and a window ranks them. The
first table goes ahead, as its k-th best score spares the others' tiles what cannot rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizmill.llm.common import Scratch, table

#: Tables of the index.
TABLES = 8
#: Rows of a bucket, about, from which tables get one more rotation (and as many times more buckets as there are axes).
BUCKET_ROWS = 2_000
#: Queries in the calibration, at most, the share of their neighbours to find, and bytes of their neighbours at most.
SAMPLE, TARGET, SAMPLE_BYTES = 256, 0.96, 64 << 20
#: Probes of a query at most with several rotations; with one, all buckets can be probed.
PROBES = 2_048
#: Rows and queries of a tile.
BLOCK, QUERY_BLOCK = 8_192, 4_096
#: Rows, queries or pairs that a numpy step handles at once.
STEP, PAIR_STEP = 1_000, 1 << 17

RESULT = "query_id long, rank int, vec_id long, score double"
_MARGIN = 1e-9


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as doubles, padded with zeros to ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    rows = np.repeat(np.arange(len(column)), sizes)
    places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, places] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def unpacked(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def packed(x: np.ndarray) -> list[bytes]:
    return [v.tobytes() for v in np.ascontiguousarray(x)]


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row (a power of two wide), without changing lengths."""
    rows, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(rows, width // (2 * step), 2, step)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(rows, width)
        step *= 2
    return x / np.sqrt(width)


class Tables:
    """The rotations of all tables; everything follows from the dimension, the greatest length and a seed."""

    def __init__(self, dim: int, longest: float, rotations: int, tables: int = TABLES, seed: int = 11):
        self.dim, self.longest, self.rotations, self.tables = dim, longest, rotations, tables
        self.width = 1 << int(np.ceil(np.log2(dim + 1)))
        self.axes = 2 * self.width
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, rotations, 3, self.width))

    def _unit(self, x: np.ndarray, data: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        if data:
            out[:, : self.dim] = x / self.longest
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (out[:, : self.dim] ** 2).sum(axis=1)))
        else:
            x = x / np.abs(x).max(axis=1, keepdims=True)
            out[:, : self.dim] = x / np.sqrt((x**2).sum(axis=1, keepdims=True))
        return out

    def _coordinates(self, unit: np.ndarray, t: int, r: int) -> np.ndarray:
        """Along the signed axes of a rotation: the positive ones, then the negative ones."""
        for signs in self.signs[t, r]:
            unit = hadamard(unit * signs)
        return np.concatenate((unit, -unit), axis=1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The bucket of every row in every table."""
        unit = self._unit(x, True)
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            for r in range(self.rotations):
                out[:, t] = out[:, t] * self.axes + self._coordinates(unit, t, r).argmax(axis=1)
        return out

    def probes(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(tables, buckets) that each query probes, best first, ``most`` at most.

        The sum over a table's rotations grows with each, so the best partial sums
        are all that the best sums can come from.
        """
        unit = self._unit(q, False)
        sums, codes = [], []
        for t in range(self.tables):
            best, code = np.zeros((len(q), 1)), np.zeros((len(q), 1), np.int64)
            for r in range(self.rotations):
                along = self._coordinates(unit, t, r)
                best = (best[:, :, None] + along[:, None, :]).reshape(len(q), -1)
                code = (code[:, :, None] * self.axes + np.arange(self.axes)).reshape(len(q), -1)
                if best.shape[1] > most:
                    keep = np.argpartition(-best, most - 1, axis=1)[:, :most]
                    best, code = np.take_along_axis(best, keep, 1), np.take_along_axis(code, keep, 1)
            sums.append(best)
            codes.append(code)
        widths = [s.shape[1] for s in sums]
        every, code = np.concatenate(sums, axis=1), np.concatenate(codes, axis=1)
        which = np.repeat(np.arange(self.tables), widths)
        order = np.argsort(-every, axis=1, kind="stable")[:, :most]
        return which[order], np.take_along_axis(code, order, 1)

    def all_buckets(self) -> int:
        return self.tables * self.axes**self.rotations


def needed_probes(tables: Tables, q: np.ndarray, near: list[np.ndarray], most: int) -> np.ndarray:
    """For every (query, neighbour) the number of probes after which they have met; ``most`` + 1 if they never do."""
    out = []
    for k, own in enumerate(near):
        if not len(own):
            continue
        which, code = tables.probes(q[k : k + 1], most)
        met = tables.buckets(own)[:, which[0]] == code[0]
        out.append(np.where(met.any(axis=1), met.argmax(axis=1) + 1, most + 1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def calibrated(dim: int, longest: float, count: int, q: np.ndarray, near: list[np.ndarray], target: float, bucket_rows: int = BUCKET_ROWS) -> tuple[Tables, int]:
    """The tables for ``count`` rows and the number of probes; fewer rotations if the target is out of reach."""
    axes = Tables(dim, longest, 1).axes
    rotations = max(1, int(np.ceil(np.log(max(1.0, count / bucket_rows)) / np.log(axes))))
    while True:
        tables = Tables(dim, longest, rotations)
        most = tables.all_buckets() if rotations == 1 else PROBES
        needed = np.sort(needed_probes(tables, q, near, most))
        probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) if len(needed) else 1
        if probes <= most:
            return tables, probes
        rotations -= 1


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed component by component from the first, in doubles."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out += q[:, i] * x[:, i]
    return np.where(np.isnan(out), -np.inf, out)


def best_of(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): each query's k best rows but itself, exactly, without those under its ``least``."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, (PAIR_STEP * 16) // max(1, len(x)))
    for at in range(0, len(q) if len(x) else 0, step):
        own, part = query_ids[at : at + step], q[at : at + step]
        with np.errstate(all="ignore"):
            rough = np.nan_to_num(part @ x.T, nan=-np.inf)
            rough[own[:, None] == ids[None, :]] = -np.inf
            bar = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(part), -np.inf)
            bar = bar if least is None else np.maximum(bar, least[at : at + step])
            slack = _MARGIN * np.sqrt((part**2).sum(axis=1) * (x**2).sum(axis=1).max())
            bar = np.where(np.isfinite(bar) & np.isfinite(slack), bar - slack, -np.inf)
        row, col = np.nonzero((rough >= bar[:, None]) & (own[:, None] != ids[None, :]))
        score = np.empty(len(row))
        for a in range(0, len(row), PAIR_STEP):
            with np.errstate(all="ignore"):
                score[a : a + PAIR_STEP] = exact_scores(part[row[a : a + PAIR_STEP]], x[col[a : a + PAIR_STEP]])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((own[row[keep]], ids[col[keep]], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (vec_id, embedding) that take part, with their size and length.

    The length is the greatest component times a root, which no component is too large for.
    """
    for batch in batches:
        batch = batch.filter(pc.and_(pc.is_valid(batch.column(0)), pc.is_valid(batch.column(1))))
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            sizes = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int32)
            x = matrix(part.column(1), max(1, int(sizes.max())))
            top = np.abs(x).max(axis=1)
            good = np.isfinite(top) & (top > 0)
            scale = np.where(good, top, 1)[:, None]
            with np.errstate(all="ignore"):
                length = top * np.sqrt(((x / scale) ** 2).sum(axis=1))
            rows = pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes), pa.array(length)], names=["vec_id", "embedding", "size", "length"])
            yield rows.filter(pa.array(good))


def _vectors(batches: Iterator[pa.RecordBatch], dim: int, step: int = STEP) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, vectors) of runs of rows (id, embedding)."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, part.column(0).to_numpy().astype(np.int64), matrix(part.column(1), dim)


def _true_neighbours(sent, dim: int, k: int):
    """A task's k best rows of every sampled query: query_id, vec_id, score, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = sent.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, dim)))
        for _, ids, x in _vectors(batches, dim):
            of, vec, score = best_of(query_ids, q, ids, x, k)
            where = np.argsort(ids, kind="stable")
            rows = x[where[np.searchsorted(ids[where], vec)]]
            of, vec, score, rows = (np.concatenate(c) for c in zip(held, (of, vec, score, rows), strict=True))
            order = np.lexsort((vec, -score, of))
            order = order[np.arange(len(order)) - np.searchsorted(of[order], of[order]) < k]
            held = (of[order], vec[order], score[order], rows[order])
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(held[2]), pa.array(packed(held[3]), pa.binary())], names=["query_id", "vec_id", "score", "vector"])

    return run


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def _hashed(tables: Tables):
    """Rows with their bucket in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, x in _vectors(batches, tables.dim):
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(tables.buckets(x))], names=["vec_id", "embedding", "buckets"])

    return run


def _probing(tables: Tables, probes: int):
    """Queries with the tables and buckets that they probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, q in _vectors(batches, tables.dim, 50):
            which, code = tables.probes(q, probes)
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(which.astype(np.int32)), _lists(code)], names=["query_id", "embedding", "tables", "buckets"])

    return run


def _solve(dim: int, k: int):
    """A group's tables and buckets one after the other: query_id, vec_id, score of each query's best rows over all of them."""

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(queries) and len(rows):
            queries, rows = queries.sort_values("bucket", kind="stable"), rows.sort_values("bucket_", kind="stable")
            code, ids = rows["bucket_"].to_numpy(np.int64), rows["vec_id"].to_numpy(np.int64)
            x = _padded(rows["embedding_"], dim)
            asked, own = queries["bucket"].to_numpy(np.int64), queries["query_id"].to_numpy(np.int64)
            q, least = _padded(queries["embedding"], dim), queries["least"].to_numpy(np.float64)
            for bucket in np.intersect1d(asked, code):
                a, b = np.searchsorted(asked, bucket), np.searchsorted(asked, bucket, side="right")
                c, d = np.searchsorted(code, bucket), np.searchsorted(code, bucket, side="right")
                found.append(best_of(own[a:b], q[a:b], ids[c:d], x[c:d], k, least[a:b]))
        of, vec, score = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((vec, -score, of))
        of, vec, score = of[order], vec[order], score[order]
        keep = np.arange(len(of)) - np.searchsorted(of, of) < k
        return pd.DataFrame({"query_id": of[keep], "vec_id": vec[keep], "score": score[keep]})

    return run


def _padded(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _met(queries: DataFrame, rows: DataFrame, scratch: Scratch, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score from the buckets that queries (query_id, t, bucket, embedding, least) and rows (vec_id, t, bucket, embedding) share.

    Buckets of one table that together have about a tile of rows form a group; one that has more than a
    tile on either side is a group of its own, in tiles of rows and of queries that all meet.
    """
    key = ["t", "bucket"]
    sizes = rows.groupBy(key).agg(F.count("*").alias("rows")).join(queries.groupBy(key).agg(F.count("*").alias("queries")), key)
    sizes = sizes.withColumn("large", (F.col("rows") > BLOCK) | (F.col("queries") > QUERY_BLOCK))
    sizes = scratch.written(sizes, "sizes")
    groups = sizes.agg(F.ceil(F.sum("rows") / BLOCK).cast("long")).first()[0] or 1  # over all tables
    group = F.when(F.col("large"), F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("bucket"), F.lit(max(1, groups // TABLES))))
    tiles = F.when(F.col("large"), F.ceil(F.col("rows") / BLOCK)).otherwise(1)
    sides = F.when(F.col("large"), F.ceil(F.col("queries") / QUERY_BLOCK)).otherwise(1)
    plan = scratch.written(sizes.select(*key, group.alias("g"), tiles.cast("int").alias("tiles"), sides.cast("int").alias("sides")), "plan")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = queries.join(plan, key).withColumn("b", F.pmod(F.xxhash64("query_id"), "sides").cast("int")).withColumn("d", every("tiles"))
    right = rows.join(plan, key).withColumn("d", F.pmod(F.xxhash64("vec_id"), "tiles").cast("int")).withColumn("b", every("sides"))
    dealt = ["t", "g", "d", "b"]
    left = left.select(*dealt, "query_id", "bucket", "embedding", "least").groupBy(*dealt)
    right = right.select(*[F.col(c).alias(f"{c}_") for c in dealt], "vec_id", F.col("bucket").alias("bucket_"), F.col("embedding").alias("embedding_")).groupBy(*[f"{c}_" for c in dealt])
    return left.cogroup(right).applyInPandas(_solve(dim, k), "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of every query; a pair that met in several tables has one score, so it has one rank."""
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.groupBy("query_id", "rank").agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))


def nearest(vectors: DataFrame, is_query, k: int = 20, target: float = TARGET, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k other rows of largest inner product that its probes find.

    ``vectors`` needs vec_id (unique) and embedding; other columns are ignored.
    ``is_query`` is a condition on vec_id. Rows without vec_id, null, empty and
    zero vectors and those with null or non-finite components take no part; shorter
    vectors count as padded with zeros to the longest. Scores are sums of products of the
    original components in doubles, from the first on; a sum that is no number counts as
    least. Ties go to the smaller vec_id; equal vectors are rows of their own. Every
    row is in every table. A query that finds fewer than k rows though there are more meets all rows, so
    one with fewer than k others gets them all. No rows give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "polytope")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    kind = rows.schema["embedding"].dataType.simpleString()
    valid = scratch.written(rows.mapInArrow(_clean, f"vec_id long, embedding {kind}, size int, length double"), "vectors")
    facts = valid.agg(F.count("*").alias("n"), F.max("size").alias("dim"), F.max("length").alias("longest")).first()
    if not facts["n"]:
        return spark.createDataFrame([], RESULT)
    valid = valid.select("vec_id", "embedding")
    dim, count = facts["dim"], facts["n"]
    longest = min(facts["longest"] * (1 + 1e-12), np.finfo(np.float64).max)
    queries = valid.where(is_query).withColumnRenamed("vec_id", "query_id")
    # Calibration on a bounded sample of the queries.
    asked = min(SAMPLE, max(8, SAMPLE_BYTES // (8 * dim * k)))
    drawn = queries.orderBy(F.xxhash64("query_id", F.lit(5)), "query_id").limit(asked).toArrow()
    sample = drawn["query_id"].to_numpy().astype(np.int64), matrix(drawn["embedding"], dim)
    sent = spark.sparkContext.broadcast(sample)
    best = valid.mapInArrow(_true_neighbours(sent, dim, k), "query_id long, vec_id long, score double, vector binary")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    near = best.withColumn("place", place).where(F.col("place") <= k).select("query_id", "vector").toPandas()  # SAMPLE_BYTES at most
    own = {i: unpacked(g) for i, g in near.groupby("query_id")["vector"]}
    tables, probes = calibrated(dim, longest, count, sample[1], [own.get(i, np.zeros((0, dim))) for i in sample[0]], target, bucket_rows)
    # The index: every row in every table; and the queries' probes.
    hashed = scratch.written(valid.mapInArrow(_hashed(tables), f"vec_id long, embedding {kind}, buckets array<long>"), "hashed")
    postings = hashed.select("vec_id", F.posexplode("buckets").alias("t", "bucket"), "embedding")
    asks = scratch.written(queries.mapInArrow(_probing(tables, probes), f"query_id long, embedding {kind}, tables array<int>, buckets array<long>"), "asks")
    probed = asks.select("query_id", F.explode(F.arrays_zip("tables", "buckets")).alias("p"), "embedding")
    probed = probed.select("query_id", F.col("p.tables").alias("t"), F.col("p.buckets").alias("bucket"), "embedding")
    # What the first table finds bounds the results from below: the others report only what reaches that.
    unbound = F.lit(float("-inf"))
    first = scratch.written(_ranked(_met(probed.where("t = 0").withColumn("least", unbound), postings.where("t = 0"), scratch, dim, k), k), "first")
    least = scratch.written(first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).drop("n"), "least")
    others = probed.where("t > 0").join(least, "query_id", "left").withColumn("least", F.coalesce("least", unbound))
    more = _met(others, postings.where("t > 0"), scratch, dim, k)
    found = scratch.written(_ranked(more.unionByName(first.select("query_id", "vec_id", "score")), k), "found")
    # Queries that found too few meet all rows, as one bucket.
    enough = found.groupBy("query_id").count().where(F.col("count") >= min(k, count - 1))
    short = scratch.written(queries.join(enough, "query_id", "left_anti"), "short")
    if short.count():
        whole = [F.lit(0).alias("t"), F.lit(0).cast("long").alias("bucket"), "embedding"]
        rest = _ranked(_met(short.select("query_id", *whole, unbound.alias("least")), valid.select("vec_id", *whole), scratch, dim, k), k)
        found = scratch.written(found.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest), "whole")
    result = scratch.written(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest")
    scratch.drop(but=("nearest",))
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

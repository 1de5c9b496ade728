"""Operator 2, packing: optimal length buckets and token-budget batches.

A global histogram of lengths goes to the driver, where dynamic programming picks
the bucket boundaries that minimise padding. It has a row for each length that
occurs: at most the root of twice the corpus's tokens. Inside
each bucket batches take as many texts, padded to the bucket's length, as the
token budget allows. Positions come from counts per (bucket, slice) and row
numbers within a slice, so no task ever holds a whole bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import table, word_count, written

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Slices of a bucket; positions within a slice are numbered by one task.
SLICES = 512


def best_boundaries(tops: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths (rising, the last is the longest) with the least padded tokens.

    cost[k][j]: least sum of bucket lengths over the texts of the first j lengths
    in at most k buckets. The best start of a last bucket never falls as j rises,
    so the middle j bounds the search on either side of it.
    """
    m = len(tops)
    if not m:
        return []
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    cost = np.concatenate([[0.0], np.full(m, np.inf)])
    came = []
    for _ in range(min(buckets, m)):
        now, back = cost.copy(), np.full(m + 1, -1)
        todo = [(1, m, 0, m - 1)]
        while todo:
            a, b, low, high = todo.pop()
            j = (a + b) // 2
            end = min(j, high + 1)
            price = cost[low:end] + (upto[j] - upto[low:end]) * tops[j - 1]
            i = low + int(np.argmin(price))
            if price[i - low] < now[j]:
                now[j], back[j] = price[i - low], i
            if a < j:
                todo.append((a, j - 1, low, i))
            if j < b:
                todo.append((j + 1, b, i, high))
        came.append(back)
        cost = now
    ends, j = [], m
    for back in reversed(came):
        if j and back[j] >= 0:
            ends.append(int(tops[j - 1]))
            j = int(back[j])
    return ends[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket_len, batch_id, slot, one row for each row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored. Tokens are words.
    Null and empty texts have 0 tokens and join the shortest bucket. A text longer
    than the budget makes a batch of its own. Repeated rows take slots of their
    own; they, and rows without doc_id, are told apart by a hash of the whole text,
    and rows that are alike in that too may swap slots. batch_id is
    ``<bucket_len>-<number>``; order within a bucket follows a hash of the id and
    the text. No rows give no rows.
    """
    spark = docs.sparkSession
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.col("text"), F.lit(17))
    sized = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count().alias("n_tokens"), place.alias("order")), "pack-sizes")
    histogram = sized.groupBy(F.col("n_tokens").alias("top")).count().collect()  # a row a length
    found = sorted((r["top"], r["count"]) for r in histogram)
    ends = best_boundaries(np.array([x for x, _ in found], np.int64), np.array([n for _, n in found], np.int64), buckets)
    edges = F.array(*[F.lit(x).cast("long") for x in ends]) if ends else F.array().cast("array<long>")
    bucket_len = F.get(F.filter(edges, lambda x: x >= F.col("n_tokens")), 0)
    placed = sized.withColumn("bucket_len", bucket_len).withColumn("slice", F.pmod("order", F.lit(SLICES)))
    counts = placed.groupBy("bucket_len", "slice").count().collect()  # at most BUCKETS * SLICES rows
    starts, total = [], {}
    for r in sorted(counts, key=lambda r: (r["bucket_len"], r["slice"])):
        starts.append((r["bucket_len"], r["slice"], total.get(r["bucket_len"], 0)))
        total[r["bucket_len"]] = total.get(r["bucket_len"], 0) + r["count"]
    offsets = spark.createDataFrame(starts, "bucket_len long, slice long, start long")
    within = F.row_number().over(Window.partitionBy("bucket_len", "slice").orderBy("order", "doc_id"))
    numbered = placed.withColumn("within", within).join(F.broadcast(offsets), ["bucket_len", "slice"])
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    position = F.col("start") + F.col("within") - 1
    return numbered.select(
        "doc_id", "n_tokens", "bucket_len",
        F.concat_ws("-", F.col("bucket_len"), F.floor(position / size).cast("string")).alias("batch_id"),
        (position % size).alias("slot"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

"""Operator 7: mixing sources to target weights.

Tokens are summed per source, each source's target gives its repetition rate,
and every document is emitted floor(rate) times plus one copy with probability
equal to the fraction, drawn from a hash of its id (so reruns agree).

Targets fill by weight: target = min(3 * size, level * weight) with the level at
which the targets sum to all sizes. The level is found in closed form from
running sums over the sources ordered by size / weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import table, word_count, written

MOST_REPEATS = 3
SEED = "mix-1"
#: Up to so many sources the table of rates is sent to all executors (under 1 MB).
BROADCAST_SOURCES = 5_000


def source_rates(sized: DataFrame) -> DataFrame:
    """source, source_size, target, rate from (source, size); one row per source, null too."""
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.expr("1") + (F.row_number().over(by_name) - 1) % 3)
    rising = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    weights = F.sum("weight").over(everything)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST_REPEATS
    used = F.coalesce(F.sum("weight").over(before), F.lit(0))
    # With all earlier sources at their most, this would be the level for the rest.
    per = per.withColumn("level", (total - capped).cast("double") / (weights - used).cast("double"))
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * MOST_REPEATS
    per = per.withColumn("final", F.min(F.when(fits, F.struct(F.col("source_size") / F.col("weight"), F.col("level"))))
                         .over(everything))
    target = F.coalesce(
        F.least((F.col("source_size") * MOST_REPEATS).cast("double"), F.col("final.level") * F.col("weight")),
        (F.col("source_size") * MOST_REPEATS).cast("double"),
    )
    per = per.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1) from the id alone."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def with_copies(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as ``row``, with doc_id, size, source_size, target and copies."""
    sized = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), "doc_id", "source", word_count().alias("size"))
    rates = written(source_rates(sized.select("source", "size")), "mix-rates")
    rates = rates.select(F.col("source").alias("_source"), "source_size", "target", "rate")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    joined = sized.join(rates, sized["source"].eqNullSafe(rates["_source"]))
    whole = F.floor("rate")
    extra = F.when(draw(F.col("doc_id")) < F.col("rate") - whole, 1).otherwise(0)
    return joined.select("row", "doc_id", "size", "source_size", "target", (whole + extra).cast("int").alias("copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs``, each row as often as the mix takes it; columns as they were.

    Null sources form a source of their own. Documents without words weigh
    nothing and come out by the same draw; texts are counted whole, however long.
    Repeated rows, and rows with one doc_id, draw alike; rows without doc_id draw as
    one id. Sources that tie in size per weight are filled in order of their
    names. A source of size 0 gives no rows, and no rows give no rows.
    """
    copies = with_copies(docs).where("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, one row for each row of ``docs``.

    ``docs`` needs doc_id, text and source; other columns are ignored. Null and
    empty texts have size 0, and long texts are counted whole; repeated rows are
    rows of their own with equal draws, rows without doc_id draw as one id; ties in
    size per weight are filled in order of the sources' names; no rows give no rows.
    """
    rows = with_copies(docs.select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM r),
f AS (SELECT arg_min(level, source_size / weight) AS level FROM l WHERE level * weight <= 3 * source_size),
t AS (SELECT l.source, l.source_size, coalesce(least((3 * l.source_size)::DOUBLE, f.level * l.weight), (3 * l.source_size)::DOUBLE) AS target FROM l LEFT JOIN f ON true),
u AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT d.doc_id, d.size::BIGINT AS size, u.source_size, u.target,
  (d.size * (floor(u.rate) + CASE WHEN ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, 'null') || ':mix-1'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < u.rate - floor(u.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
"""

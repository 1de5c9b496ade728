"""Operator 3, exact dedup: a log-structured merge index over text digests.

Memtables: every scan task digests its rows and flushes them as one run sorted
by digest, a Parquet file whose footer carries a Bloom filter on the digest.
Compaction merges the runs by digest (Spark's aggregate: partial in every run,
merged behind the shuffle) into a level, sorted and with filters again, and keeps,
per digest, the smallest identifiers and the row that stays. A filter of bounded
size over the level's digests with several rows meets the runs: rows that it
excludes are alone and need no lookup; the others are looked up in the level. Hits
have their texts read, again behind a filter, and each text is compared byte by
byte with that of the row that stays. Where bytes differ (a digest collision) the
rows are grouped again by the bytes themselves, so that the digest's width never
affects the result.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.common import SEPARATORS, Scratch, filter_of, new_path, passes, table, text_or_empty, without_rows


def normalised(column: str = "text") -> Column:
    return F.translate(text_or_empty(column), SEPARATORS, "")


class DigestIndex:
    """Sorted digest runs and a compacted level below one folder of the shared file system.

    Files are sorted by digest and carry a Bloom filter on it, so that ``find``
    opens only row groups that may hold a digest.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, digest_bytes: int = 16):
        self.spark, self.folder, self.digest_bytes = spark, folder or new_path(spark, "lsm"), digest_bytes
        self.waiting: list[DataFrame] = []
        self.level: DataFrame | None = None

    def _write(self, rows: DataFrame, kind: str) -> DataFrame:
        path = f"{self.folder}/{kind}-{uuid.uuid4().hex}"
        sorted_rows = rows.sortWithinPartitions("digest").write.option("compression", "zstd")
        sorted_rows.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.max.bytes", str(1 << 18)).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def digested(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("digest", F.substring("text_sha256", 1, 2 * self.digest_bytes))

    def flush(self, docs: DataFrame) -> DataFrame:
        """Writes the documents' digests, one sorted run per task: (doc_id, text_sha256, points, digest)."""
        rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.sha2(F.encode(normalised(), "utf-8"), 256).alias("text_sha256"),
            F.char_length(text_or_empty()).cast("long").alias("points"),
        )
        run = self._write(self.digested(rows), "run")
        self.waiting.append(run)
        return run

    def compact(self) -> DataFrame:
        """Merges waiting runs into the level: per digest the row that stays, the number of rows and the smallest id."""
        found = [r.select("digest", F.col("doc_id").alias("keep_id"), "points", F.lit(1).cast("long").alias("group_size"), F.col("doc_id").alias("first_id")) for r in self.waiting]
        merged = reduce(DataFrame.unionByName, [*found, *([self.level] if self.level else [])])
        best = F.max(F.struct(F.col("keep_id").isNotNull().alias("named"), F.col("points"), (-F.col("keep_id")).alias("minus_id"))).alias("best")
        level = merged.groupBy("digest").agg(best, F.sum("group_size").alias("group_size"), F.min("first_id").alias("first_id"))
        self.level = self._write(level.select("digest", (-F.col("best.minus_id")).alias("keep_id"), "best.points", "group_size", "first_id"), "level")
        self.waiting = []
        return self.level

    def lookup(self, run: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """(rows of a flushed run that are alone with their digest, the others with keep_id and group_size from the level)."""
        level = self.level if self.level is not None else self.compact()
        several = level.where("group_size > 1").select("digest", "keep_id", "group_size")
        bits, filled = filter_of(several.select(F.xxhash64("digest")), several.count())
        sent = self.spark.sparkContext.broadcast(filled)
        asked = scratch.written(run.withColumn("maybe", passes(sent)(F.pmod(F.xxhash64("digest"), F.lit(bits)))), "asked")
        sent.destroy()
        found = scratch.written(asked.where("maybe").drop("maybe").join(several, "digest", "left"), "found")
        alone = asked.where("not maybe").drop("maybe").unionByName(found.where("group_size is null").drop("keep_id", "group_size"))
        return alone, found.where("group_size is not null")

    def find(self, texts: list[str]) -> DataFrame:
        """Rows of the level for the given texts: a lookup by pushed-down digests."""
        digests = [hashlib.sha256(t.translate(dict.fromkeys(map(ord, SEPARATORS))).encode()).hexdigest()[: 2 * self.digest_bytes] for t in texts]
        return (self.level or self.compact()).where(F.col("digest").isin(digests))


def exact_dedup(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row for each row of ``docs``.

    ``docs`` needs doc_id (unique) and text; other columns are ignored.
    Texts are equal when they are identical without white space, whatever their
    length: digests and comparisons take whole texts. Null texts count as empty;
    empty texts form one group. Repeated rows with one doc_id and one text count
    as members each and are all marked kept if their id stays. Ties in length go
    to the smallest doc_id. Rows without doc_id stay only where no row with one
    has their text. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    index = DigestIndex(spark, digest_bytes=digest_bytes)
    run = index.flush(docs)
    index.compact()
    alone, hits = index.lookup(run, scratch)
    out = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    if some := hits.count():
        differs, texts = _verified(docs, index, hits, some, scratch)
        collided = differs.count() > 0
        sure = hits.join(differs, "digest", "left_anti") if collided else hits
        out = out.unionByName(sure.select("doc_id", "keep_id", "group_size", "text_sha256"))
        if collided:
            out = out.unionByName(_by_bytes(texts.join(differs, "digest", "left_semi")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _verified(docs: DataFrame, index: DigestIndex, hits: DataFrame, count: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(digest) whose texts are not all the same bytes; and (doc_id, digest, text_sha256, points, bytes) of the hits."""
    bits, filled = filter_of(hits.select(F.xxhash64("doc_id")), count)
    sent = index.spark.sparkContext.broadcast(filled)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(passes(sent)(F.pmod(F.xxhash64("doc_id"), F.lit(bits))))
    texts = some.select("doc_id", F.char_length(text_or_empty()).cast("long").alias("points"), normalised().alias("bytes"))
    texts = index.digested(texts.withColumn("text_sha256", F.sha2(F.encode("bytes", "utf-8"), 256)))
    texts = scratch.written(texts, "texts")
    sent.destroy()
    keepers = hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("digest", "doc_id").distinct()
    keeper = texts.join(keepers, texts["digest"].eqNullSafe(keepers["digest"]) & texts["doc_id"].eqNullSafe(keepers["doc_id"]), "left_semi")
    keeper = keeper.groupBy("digest").agg(F.min("bytes").alias("keeper_bytes"))
    keeper = scratch.written(keeper, "keepers")  # so that a large group's side of the next join can be split
    differs = scratch.written(texts.join(keeper, "digest").where("bytes <> keeper_bytes").select("digest"), "differs")
    return differs.distinct(), texts


def _by_bytes(texts: DataFrame) -> DataFrame:
    """Groups of colliding digests, by the bytes themselves."""
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), F.col("points"), (-F.col("doc_id")).alias("minus_id")))
    groups = texts.groupBy("bytes").agg(best.alias("best"), F.count("*").alias("group_size"))
    return texts.join(groups, "bytes").select("doc_id", (-F.col("best.minus_id")).alias("keep_id"), "group_size", "text_sha256")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they were; rows without doc_id all stay.

    Cases are those of ``exact_dedup``: of empty and null texts one row stays, rows
    that repeat a doc_id stay or go together, and columns with other names are
    carried along. No rows give no rows.
    """
    ids = exact_dedup(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("stays"))
    return without_rows(docs, ids.where("not stays"))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS points FROM documents),
w AS (SELECT doc_id, norm,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""

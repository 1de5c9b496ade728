"""Operator 12, source divergence audit: two passes and a vocabulary automaton.

The first pass counts, exactly, in how many documents of a language each term
occurs; the terms kept are cut into slices of bounded size. The second pass runs an
Aho-Corasick automaton of a slice's terms, each between two delimiters, over the
texts as terms between single delimiters, and recounts every occurrence per source.
The counts are sparse postings (language, source, term): terms that a source does
not use all have one share, so pairs of sources are compared on the postings of a
block of terms at a time, and what absent terms add is a product. Ranks are windows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizmill.llm.common import Scratch, table

#: A kept term occurs in so many documents of its language at least.
LEAST_DOCS = 30
#: Ranks of part ``term``.
TERM_RANKS = 50
#: Bytes of kept terms in a slice, about; a slice (three times this at most, but for one long term) becomes one automaton.
SLICE_BYTES = 4 << 20
#: Terms in a block, and sources on a side of it, that pairs are compared on.
BLOCK_TERMS, BLOCK_SOURCES = 2_048, 256
#: Terms that a task of the first pass counts, and the bytes they may come from, and occurrences that one of the second pass gathers, before they are passed on.
HELD, HELD_BYTES, OCCURRENCES = 400_000, 64 << 20, 4_000_000
#: Added to every count, and the whole that shares are parts of.
SMOOTHING, WHOLE = 5, 1_000_000_000

RESULT = "lang string, source string, part string, item string, value long, rank int"

#: Letters A-Z become small, what separates terms becomes a space; bytes from 128 on belong to terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return text.encode().translate(_TERMS).split(b" ") if text else []


def _columns(batch: pa.RecordBatch) -> zip:
    return zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _counts(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of the batch's rows that hold the term."""
    kinds = {"lang": pa.string(), "term": pa.string(), "n": pa.int64()}
    held: defaultdict[str, Counter] = defaultdict(Counter)
    size = 0

    def out() -> pa.RecordBatch:
        return _counts([(lang, t.decode(), n) for lang, of in held.items() for t, n in of.items() if t], kinds)

    for batch in batches:
        for lang, text in _columns(batch):
            own = set(terms(text))
            size += sum(map(len, own))
            held[lang].update(own)
            if size > HELD_BYTES or sum(map(len, held.values())) > HELD:
                yield out()
                held.clear()
                size = 0
    yield out()


def _automata(kept: list[tuple[str, str, int]]) -> dict[str, ahocorasick.Automaton]:
    """An automaton for each language of a slice over its terms between delimiters; matches give the terms' numbers."""
    out: dict[str, ahocorasick.Automaton] = {}
    for lang, term, number in kept:
        if lang not in out:
            out[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        out[lang].add_word(f" {term} ", number)
    for automaton in out.values():
        automaton.make_automaton()
    return out


def _occurrences(sent):
    """(lang, source, number, n) of a slice's terms in the batch's rows."""

    def counted(groups: dict[tuple, int], found: list[np.ndarray]) -> pa.RecordBatch:
        """Counts of found (group, number) codes."""
        code, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        group = pa.array((code >> 32).astype(np.int32))
        names = [pa.DictionaryArray.from_arrays(group, pa.array([key[i] for key in groups], pa.string())).cast(pa.string()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*names, pa.array(code & 0xFFFFFFFF), pa.array(n.astype(np.int64))], names=["lang", "source", "number", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _automata(sent.value)
        groups: dict[tuple, int] = {}
        found, held = [], 0
        for batch in batches:
            for lang, source, text in _columns(batch):
                if lang not in automata:
                    continue
                delimited = (b" " + b" ".join(filter(None, terms(text))) + b" ").decode()
                numbers = np.fromiter((number for _, number in automata[lang].iter(delimited)), np.int64)
                found.append(numbers | (groups.setdefault((lang, source), len(groups)) << 32))
                held += len(numbers) + 1
                if held > OCCURRENCES:
                    yield counted(groups, found)
                    groups, found, held = {}, [], 0
        yield counted(groups, found)

    return run


def kept_terms(docs: DataFrame, scratch: Scratch, least: int, slice_bytes: int) -> DataFrame:
    """(lang, term, slice, number): the vocabulary of every language; numbers count within a slice."""
    found = docs.select("lang", "text").mapInArrow(_document_frequencies, "lang string, term string, n long")
    kept = scratch.written(found.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("n"), "kept")
    # A language with more than a slice has slices of its own; smaller ones share them. One row a language passes one task.
    sizes = kept.groupBy("lang").agg(F.sum(F.octet_length("term") + 2).alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("base", F.floor(F.coalesce(before, F.lit(0)) / slice_bytes)).withColumn("pieces", F.ceil(F.col("bytes") / slice_bytes))
    cut = kept.join(sizes.drop("bytes"), "lang").withColumn("slice", (F.col("base") + F.pmod(F.xxhash64("term"), "pieces")).cast("int"))
    number = F.row_number().over(Window.partitionBy("slice").orderBy("lang", "term"))  # a slice is small
    return scratch.written(cut.select("lang", "term", "slice", number.cast("long").alias("number")), "terms")


def postings_of(docs: DataFrame, vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, term, n), n > 0: occurrences of kept terms, one pass over the texts for each slice."""
    parts = []
    for (k,) in sorted(vocabulary.select("slice").distinct().collect()):  # a row for each 4 MB of terms
        own = vocabulary.where(F.col("slice") == k).drop("slice")
        sent = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own.select("lang", "term", "number").collect()])  # a slice
        found = docs.select("lang", "source", "text").mapInArrow(_occurrences(sent), "lang string, source string, number long, n long")
        found = found.groupBy("lang", "source", "number").agg(F.sum("n").alias("n"))
        parts.append(scratch.written(found.join(own, ["lang", "number"]).drop("number"), "postings"))
        sent.destroy()
    empty = docs.sparkSession.createDataFrame([], "lang string, source string, n long, term string")
    out = empty
    for part in parts:
        out = out.unionByName(part)
    return out


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (count + SMOOTHING) / (total + SMOOTHING * kept)), exact for counts of any size a long holds; null if nothing is kept."""
    wide = "decimal(20,0)"
    above = (count.cast(wide) + F.lit(SMOOTHING).cast("decimal(1,0)")) * F.lit(WHOLE).cast("decimal(10,0)")
    below = total.cast(wide) + kept.cast(wide) * F.lit(SMOOTHING).cast("decimal(1,0)")
    return F.when(kept > 0, F.call_function("div", above, below) + 1)


def _compared(postings: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """lang, source, item, value for the sources of two sides: sum over the block's terms of the distance of shares beyond that of absent terms."""
    sources = sources.sort_values(["side", "source"], kind="stable")
    names, sides, absent = sources["source"].to_numpy(), sources["side"].to_numpy(), sources["absent"].fillna(0).to_numpy(np.int64)
    place = {key: k for k, key in enumerate(zip(sides, names, strict=True))}
    number, code = np.unique(postings["term"].to_numpy(), return_inverse=True) if len(postings) else (np.zeros(0), np.zeros(0, np.int64))
    p = np.repeat(absent[:, None], len(number), axis=1)
    at = np.array([place[key] for key in zip(postings["side_"], postings["source_"], strict=True)], np.int64)
    p[at, code] = postings["p"].to_numpy(np.int64)
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == sides.max())
    out = []
    for a in left:
        beyond = np.abs(p[right] - p[a]) - np.abs(absent[right] - absent[a])[:, None]
        out.append(beyond.sum(axis=1))
    value = np.concatenate(out)
    one, other = np.repeat(names[left], len(right)), np.tile(names[right], len(left))
    frame = pd.DataFrame({"lang": sources["lang"].iloc[0], "source": one, "item": other, "value": value})
    if sides.max():  # two different sides: both directions
        frame = pd.concat([frame, frame.rename(columns={"source": "item", "item": "source"})])
    return frame[frame["source"] != frame["item"]][["lang", "source", "item", "value"]]


def pair_distances(postings: DataFrame, groups: DataFrame, block_terms: int, block_sources: int) -> DataFrame:
    """(lang, source, item, value): every ordered pair of sources of a language.

    ``postings`` has lang, source, term, p; ``groups`` lang, source, kept, absent (the share of a term
    that the source does not use). Sources are numbered within their language and cut into sides; a block is
    a part of the terms on two sides.
    """
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    placed = groups.withColumn("tile", F.floor(place / block_sources)).withColumn("tiles", F.max("tile").over(Window.partitionBy("lang")) + 1)
    placed = placed.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("kept") / block_terms)))
    # (i, j) with i <= j for every tile that is one of both; side 0 is i, side 1 is j.
    meets = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
        lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j"), F.when(t < F.col("tile"), 1).otherwise(0).alias("side")),
    )
    met = placed.withColumn("met", F.explode(meets)).select("lang", "source", "absent", "chunks", "met.*")
    sources = met.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    cells = postings.join(met.drop("absent"), ["lang", "source"]).withColumn("chunk", F.pmod(F.xxhash64("term"), "chunks"))
    key = ["lang", "chunk", "i", "j"]
    cells = cells.select(*[F.col(c).alias(f"{c}_") for c in key], F.col("source").alias("source_"), F.col("side").alias("side_"), "term", "p")
    beyond = cells.groupBy(*[f"{c}_" for c in key]).cogroup(sources.groupBy(*key)).applyInPandas(_compared, "lang string, source string, item string, value long")
    return beyond.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = TERM_RANKS, slice_bytes: int = SLICE_BYTES, block_terms: int = BLOCK_TERMS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language are from each other and from their language.

    ``docs`` needs text, lang and source; other columns are ignored. Null text, lang and
    source count as ''. Part ``pair`` has every other source of the language by distance
    of the shares of its kept terms; part ``term`` the terms that a source uses more than its
    language does, to rank ``ranks``. Ties go by the item's UTF-8 bytes. Texts are counted whole;
    repeated rows and rows without doc_id count as documents each. A language without kept
    terms has its pairs, all 0, and no terms; a source alone in its language has no pairs. No
    rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    vocabulary = kept_terms(docs, scratch, least, slice_bytes)
    postings = postings_of(docs, vocabulary, scratch)
    # Sizes: the number of kept terms of a language, the occurrences of a source and of a language.
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "kept"])
    groups = groups.withColumn("of_lang", F.sum("total").over(Window.partitionBy("lang")))
    groups = scratch.written(groups.withColumn("absent", share(F.lit(0), F.col("total"), F.col("kept"))), "groups")
    shared = postings.withColumn("n_lang", F.sum("n").over(Window.partitionBy("lang", "term")))
    shared = shared.join(groups.select("lang", "source", "total", "of_lang", "kept"), ["lang", "source"])
    shared = shared.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("n_lang"), F.col("of_lang"), F.col("kept")).alias("q"))
    shared = scratch.written(shared, "shares")
    # Pairs: what the blocks found, and the distance of absent terms once for every kept term.
    beyond = pair_distances(shared, groups, block_terms, block_sources)
    own = groups.select("lang", "source", "kept", F.coalesce("absent", F.lit(0)).alias("absent"))
    other = own.select("lang", F.col("source").alias("item"), F.col("absent").alias("other"))
    pairs = beyond.join(own, ["lang", "source"]).join(other, ["lang", "item"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("value") + F.col("kept") * F.abs(F.col("absent") - F.col("other"))).alias("value"))
    terms_above = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).unionByName(terms_above.withColumn("rank", rank).where(F.col("rank") <= ranks))
    result = scratch.written(ranked.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in RESULT.split(", ")]), "audit")
    scratch.drop(but=("audit",))
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
cl AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY lang, term),
nl AS (SELECT lang, sum(n)::BIGINT AS t FROM cl GROUP BY lang),
ng AS (SELECT lang, source, sum(n)::BIGINT AS t FROM c GROUP BY lang, source),
q AS (SELECT cl.lang, cl.term, 1 + (1000000000 * (cl.n + 5)) // (nl.t + 5 * v.v) AS q FROM cl JOIN nl ON cl.lang = nl.lang JOIN v ON cl.lang = v.lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (coalesce(ng.t, 0) + 5 * v.v) AS p
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN ng ON ng.lang = g.lang AND ng.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
tops AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

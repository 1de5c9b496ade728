"""Operator 6, quality classifier: supervised subword embeddings.

Hashed word and character n-gram vectors are averaged per document and go
through a softmax layer; both are trained by numpy stochastic gradient descent
on a bounded sample of labelled documents (TRAIN_DOCS). Rows held out, those whose
crc32 of the id modulo 5 is 0, never reach the training. Because the output is
linear in the averaged vectors, scoring needs only each bucket's difference of
logits: every task gathers those from one table and averages them per document.

Features come from the text alone: every word, every pair of neighbouring words,
and every run of 2 and 4 characters (code points), hashed into BUCKETS buckets.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import blocks, table

#: The most labelled documents that training reads (a hash sample of all that may be learned from), and the most bytes of text.
TRAIN_DOCS = 6_000
TRAIN_BYTES = 64 << 20
BUCKETS = 1 << 17
DIM = 8
#: Passes over the sample: at least so many, more for small samples to come near LEAST_STEPS, at most MOST_EPOCHS.
EPOCHS, LEAST_STEPS, MOST_EPOCHS = 6, 20_000, 60
RATE = 0.4
THRESHOLD = 0.3
GRAMS = (2, 4)
#: Code points of one text that one numpy step handles at once.
CHUNK = 1 << 18

_WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Factor of a pair's first word.
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_KEPT = (_powers_of(_WORD_BASE, CHUNK + 1), _powers_of(_INVERSE, CHUNK + 1))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up to n; only those for a block of usual size are kept."""
    return _KEPT if n <= len(_KEPT[0]) else (_powers_of(_WORD_BASE, n), _powers_of(_INVERSE, n))


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(47)).astype(np.int32)  # 17 bits: BUCKETS


def _gram_buckets(points: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n code points from every place on."""
    if len(points) < n:
        return np.zeros(0, np.int32)
    end = len(points) - n + 1
    h = points[:end].astype(np.uint64)
    for k in range(1, n):
        h = h * np.uint64(0x100000001B3) + points[k : k + end]
    return _bucket(h, n)


def _words(points: np.ndarray, starts_of_texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, start) of every word; no word crosses a start of a text."""
    n = len(points)
    word = ~((points == 32) | ((points >= 9) & (points <= 13)))
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = starts_of_texts[(starts_of_texts > 0) & (starts_of_texts < n)]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * down[starts], starts


def _features(points: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all features of the texts that start at ``at`` (its last entry is the end)."""
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    for n in GRAMS:
        found = _gram_buckets(points, n)
        inside = owner[: len(found)] == owner[n - 1 : n - 1 + len(found)]
        yield owner[: len(found)][inside], found[inside]
    codes, starts = _words(points, at[:-1])
    own = owner[starts]
    yield own, _bucket(codes, 0)
    pair = own[1:] == own[:-1]
    yield own[1:][pair], _pair_buckets(codes)[pair]


def _pair_buckets(codes: np.ndarray) -> np.ndarray:
    """The bucket of every word and the one behind it."""
    return _bucket(codes[:-1] * _PAIR + codes[1:], 1)


def features(text: str) -> np.ndarray:
    """All feature buckets of one whole text, with repeats."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([found for _, found in _features(points, np.array([0, len(points)]))]) if len(points) else np.zeros(0, np.int32)


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """(logit difference of every bucket, bias), by stochastic gradient descent, one document a step."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIM, 1.0 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    # All bags in two buffers: each document's buckets and their shares.
    buckets, shares, at = array("i"), array("f"), [0]
    for text in texts:
        found, times = np.unique(features(text.as_py() or ""), return_counts=True)
        buckets.frombytes(found.astype(np.int32).tobytes())
        shares.frombytes((times / max(1, times.sum())).astype(np.float32).tobytes())
        at.append(len(buckets))
    all_buckets, all_shares, bags = np.frombuffer(buckets, np.int32), np.frombuffer(shares, np.float32), len(at) - 1
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-LEAST_STEPS // max(1, bags))))
    steps, total = 0, epochs * max(1, bags)
    for _ in range(epochs):
        for i in rng.permutation(bags):
            rate = np.float32(RATE * (1 - steps / total))
            steps += 1
            found, share = all_buckets[at[i] : at[i + 1]], all_shares[at[i] : at[i + 1]]
            hidden = share @ vectors[found]
            logits = output @ hidden + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[int(labels[i])] -= 1
            back = error @ output
            output -= rate * np.outer(error, hidden)
            bias -= rate * error
            # A bucket's share is small; its step is scaled up so that rare buckets learn at all.
            vectors[found] -= (rate * 50 * share)[:, None].clip(max=1) * back[None, :]
    return (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0])


def mean_weights(texts: pa.Array, table_of: np.ndarray) -> np.ndarray:
    """Average logit difference over every whole text's features; 0 without features."""
    out = np.zeros(len(texts))
    for row, end, offsets, raw in blocks(texts):
        if not len(raw):
            continue
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        if end - row == 1 and len(points) > CHUNK:
            out[row] = _mean_of_long(points, table_of)
            continue
        heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        total, count = np.zeros(end - row), np.zeros(end - row, np.int64)
        for own, found in _features(points, heads[offsets]):
            total += np.bincount(own, table_of[found], end - row)
            count += np.bincount(own, minlength=end - row)
        out[row:end] = total / np.maximum(count, 1)
    return out


def _mean_of_long(points: np.ndarray, table_of: np.ndarray) -> float:
    """The average of one long text, piece by piece."""
    total, count = 0.0, 0
    for at in range(0, len(points), CHUNK):
        for n in GRAMS:
            found = _gram_buckets(points[at : at + CHUNK + n - 1], n)
            total, count = total + table_of[found].sum(dtype=np.float64), count + len(found)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    at, before = 0, np.zeros(0, np.uint64)
    while at < len(points):  # words: pieces end at a separator, or run on to the next one
        end = at + CHUNK
        if end < len(points):
            after = np.flatnonzero(space[end:])
            end = end + int(after[0]) if len(after) else len(points)
        codes, _ = _words(points[at:end], np.zeros(1, np.int64))
        chain = np.concatenate([before, codes])
        for found in (_bucket(codes, 0), _pair_buckets(chain)):
            total, count = total + table_of[found].sum(dtype=np.float64), count + len(found)
        before, at = chain[-1:], end
    return float(total / count) if count else 0.0


def _scored(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(bias + mean_weights(texts, weights), -50, 50)))


def _scores(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(_scored(batch.column(1), weights, bias))], names=["doc_id", "held_out", "score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, quality): of the ids that may be learned from the first ``most`` by a hash of the id, as far as TRAIN_BYTES go.

    Of several texts with one id the first in order is learned from.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.groupBy("_id").agg(F.max("quality").alias("quality")).withColumn("_draw", F.xxhash64("_id", F.lit(5)))
    some = usable.orderBy("_draw", "_id").limit(most)
    text = F.coalesce("text", F.lit(""))
    # Lengths first: only the texts that fit are carried along.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    known = docs.join(F.broadcast(some), F.col("doc_id") == F.col("_id"))  # at most ``most`` rows, but for repeated ids
    sizes = known.groupBy("_draw", "_id").agg(F.max("quality").alias("_quality"), F.max(F.octet_length("text")).cast("long").alias("_bytes"))
    fits = sizes.withColumn("_upto", F.sum("_bytes").over(Window.orderBy("_draw", "_id"))).where(F.col("_upto") <= TRAIN_BYTES)  # ``most`` rows of numbers
    return docs.join(F.broadcast(fits), F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("_quality").alias("quality"))


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """The trained table and bias. Without labelled rows every score is one half."""
    rows = training_rows(docs, labels, most).toArrow().sort_by("doc_id")
    if not len(rows):
        return np.zeros(BUCKETS, np.float32), 0.0
    return train(rows["text"], rows["quality"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of ``docs``.

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality; other columns
    are ignored. Null texts count as empty; an empty text scores by the bias
    alone. Texts of any length are scored whole, long ones piece by piece; one
    longer than TRAIN_BYTES is not learned from. Repeated rows and equal texts
    score alike; a score of exactly THRESHOLD is accepted. Labels that are null,
    not 0 or 1, or without a document are not learned from; of contradicting
    labels for one id the 1 counts. A null id is never learned from and counts as
    not held out. No rows give no rows.
    """
    weights, bias = fitted(docs, labels, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"))
    scored = rows.mapInArrow(_scores(weights, bias), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns as they were.

    Cases are those of ``classify``: repeated rows stay or go together, null and
    empty texts by the bias alone, long texts by their whole text, and columns
    with other names are carried along. No rows give no rows.
    """
    weights, bias = fitted(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch.column(batch.schema.get_field_index("text")), weights, bias) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

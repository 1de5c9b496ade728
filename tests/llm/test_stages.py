import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quizmill.llm import knn_join, mixing, packing, quality

from . import brute

WORD = brute.WORD


def made(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({"size": F.lit(1), "rate": F.lit("x"), "_size": F.lit(2), "bucket_len": F.lit(3), "top": F.lit(4), "score": F.lit(5), "quality": F.lit(6), "copies": F.lit(7), "row": F.lit(8)})


def corpus(seed: int, n: int = 300):
    rng = random.Random(seed)
    rows = [(1, None, "a"), (2, "", None), (3, " \t", "zero"), (4, "one two", None), (5, "x " * 5000, "a")]
    return rows + [(10 + i, "w " * min(2000, int(rng.expovariate(0.02))), rng.choice(["hot", "hot", "hot", "b", "c", "é", "Z", None])) for i in range(n)]


# Operator 7


def wanted_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, target, left = sum(sizes.values()), {}, set(names)
    while left:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left.discard(s)
    return target


@pytest.mark.parametrize("rows", [corpus(1), corpus(2, 40), [(1, None, None)], []])
def test_mix_targets(spark, rows):
    got = mixing.mix(made(spark, rows)).collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    target = wanted_targets(sizes)
    by = {i: (s, len(WORD.findall(t or ""))) for i, t, s in rows}
    assert len(got) == len(rows)
    taken: dict = {}
    for r in got:
        s, size = by[r.doc_id]
        assert (r.size, r.source_size) == (size, sizes[s])
        assert math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken <= 3 * size
        taken.setdefault(s, []).append((size, r.taken))
    for s, found in taken.items():
        spread = math.sqrt(sum(n * n for n, _ in found) / 4) * 4
        assert abs(sum(t for _, t in found) - target[s]) <= spread + 1e-6


def test_mix_copies_follow_the_table(spark):
    docs = made(spark, corpus(3))
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.size}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got: dict = {}
    for r in out.collect():
        assert (r.size, r._size, r.row) == (1, 2, 8)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text or ""))
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in want.items() if n}
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


# Operator 2


def least_padding(lengths: list[int], buckets: int) -> int:
    distinct = sorted(set(lengths))
    count = [lengths.count(x) for x in distinct]
    best = [[0] + [math.inf] * len(distinct) for _ in range(buckets + 1)]
    for k in range(1, buckets + 1):
        for j in range(1, len(distinct) + 1):
            best[k][j] = min(best[k - 1][i] + distinct[j - 1] * sum(count[i:j]) for i in range(j))
            best[k][j] = min(best[k][j], best[k - 1][j])
    return best[buckets][len(distinct)]


@pytest.mark.parametrize("buckets", [1, 3, 5])
def test_packing_is_optimal(spark, buckets):
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 2, 3, 5, 8, 40, 41, 200, 900]), "s") for i in range(120)]
    got = packing.pack(made(spark, rows), buckets=buckets, budget=1000).collect()
    lengths = [len(WORD.findall(t)) for _, t, _ in rows]
    assert sorted(r.n_tokens for r in got) == sorted(lengths)
    assert sum(r.bucket_len for r in got) == least_padding(lengths, buckets)
    assert len({r.bucket_len for r in got}) <= buckets
    batches: dict = {}
    for r in got:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault(r.batch_id, []).append(r)
    for members in batches.values():
        assert len({r.bucket_len for r in members}) == 1
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert sum(r.bucket_len for r in members) <= 1000
    for b in {r.bucket_len for r in got}:
        sizes = sorted(len(m) for m in batches.values() if m[0].bucket_len == b)
        assert all(s == max(1, 1000 // max(1, b)) for s in sizes[1:])


def test_packing_of_long_texts_is_optimal(spark):
    """Boundaries are lengths that occur, above 1,024 tokens too."""
    rng = random.Random(6)
    rows = [(i, "w " * (1025 + 2 * rng.randrange(3000) + i % 2), "s") for i in range(90)]
    got = packing.pack(made(spark, rows), buckets=4).collect()
    lengths = [len(WORD.findall(t)) for _, t, _ in rows]
    assert sum(r.bucket_len for r in got) == least_padding(lengths, 4)
    assert {r.bucket_len for r in got} <= set(lengths)


def test_boundaries_against_every_split():
    rng = np.random.default_rng(3)
    for _ in range(200):
        tops = np.unique(rng.integers(0, 60, rng.integers(1, 12)))
        counts, k = rng.integers(1, 30, len(tops)), int(rng.integers(1, 6))
        ends = np.array(packing.best_boundaries(tops, counts, k))
        assert len(ends) <= k and ends[-1] == tops[-1]
        padded = int((ends[np.searchsorted(ends, tops)] * counts).sum())
        assert padded == least_padding(np.repeat(tops, counts).tolist(), k)


def test_packing_edges(spark):
    assert packing.pack(made(spark, [])).count() == 0
    rows = [(1, None, None), (1, None, None), (2, "w " * 3000, None), (None, "a b", None)]
    got = packing.pack(made(spark, rows), budget=100).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2, 3000]
    assert len({(r.batch_id, r.slot) for r in got}) == 4
    assert all(r.bucket_len >= r.n_tokens for r in got)


# Operator 6


def test_classifier_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out, strict=True))
    held = got[got.held_out]
    assert ((held.predicted == 1) == (held.quality == 1)).mean() >= 0.95
    assert set(got.predicted) <= {0, 1} and got.score.between(0, 1).all()
    kept = quality.accepted_documents(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == quality.classify(docs, labels).where("predicted = 1").count()


def test_classifier_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 7), (None, 1), (1, 1)], "doc_id long, quality int")
    rows = [(1, "good words here", None), (2, "BAD!! BAD!!", None), (3, None, None), (4, "", None), (None, "x", None), (5, "good words here", None)]
    got = {r.doc_id: r for r in quality.classify(made(spark, rows), labels).collect()}
    assert len(got) == 6 and got[3].score == got[4].score and got[1].score == got[5].score
    assert quality.classify(made(spark, rows), labels.limit(0)).where("score = 0.5").count() == 6
    assert quality.classify(made(spark, []), labels).count() == 0


def plain_features(text: str) -> list[int]:
    """All buckets of a text, one feature at a time in Python's integers."""
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def bucket(h, kind):
        return (((h ^ (kind * 0x632BE59BD9B4E019 & mask)) * 0xBF58476D1CE4E5B9) & mask) >> 47

    out = []
    for n in quality.GRAMS:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * 0x100000001B3 + ord(c)) & mask
            out.append(bucket(h, n))
    codes = [sum((ord(c) + 1) * pow(base, k, 1 << 64) for k, c in enumerate(w)) & mask for w in WORD.findall(text)]
    return out + [bucket(c, 0) for c in codes] + [bucket((a * 0xC2B2AE3D27D4EB4F + b) & mask, 1) for a, b in zip(codes, codes[1:], strict=False)]


def test_scores_against_plain_features(spark):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=quality.BUCKETS).astype(np.float32)
    texts = ["", " ", "a", "ab", "the the cat", "é\tü\n日本語 日本語 𝄞x", "x" * 300, *("".join(rng.choice(list("ab é\n"), rng.integers(0, 60))) for _ in range(60))]
    got = quality.mean_weights(pa.array([None, *texts]), weights)
    for text, mean in zip(["", *texts], got, strict=True):
        found = plain_features(text)
        assert sorted(quality.features(text).tolist()) == sorted(found)
        assert math.isclose(mean, sum(float(weights[b]) for b in found) / max(1, len(found)), rel_tol=1e-6, abs_tol=1e-9)



def plain_training(texts, labels, seed=7):
    """The trained table of ``quality.train``, a feature at a time, in doubles."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / quality.DIM, 1.0 / quality.DIM, (quality.BUCKETS, quality.DIM)).astype(np.float64)
    output, bias = [[0.0] * quality.DIM, [0.0] * quality.DIM], [0.0, 0.0]
    bags = []
    for text in texts:
        found = plain_features(text)
        bags.append({b: found.count(b) / len(found) for b in sorted(set(found))})
    epochs = min(quality.MOST_EPOCHS, max(quality.EPOCHS, -(-quality.LEAST_STEPS // len(bags))))
    steps, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            rate = quality.RATE * (1 - steps / total)
            steps += 1
            hidden = [sum(share * vectors[b][d] for b, share in bags[i].items()) for d in range(quality.DIM)]
            logits = [sum(o * h for o, h in zip(output[c], hidden, strict=True)) + bias[c] for c in (0, 1)]
            odds = [math.exp(x - max(logits)) for x in logits]
            error = [odds[c] / sum(odds) - (c == labels[i]) for c in (0, 1)]
            back = [sum(error[c] * output[c][d] for c in (0, 1)) for d in range(quality.DIM)]
            for c in (0, 1):
                output[c] = [o - rate * error[c] * h for o, h in zip(output[c], hidden, strict=True)]
                bias[c] -= rate * error[c]
            for b, share in bags[i].items():
                for d in range(quality.DIM):
                    vectors[b][d] -= min(1, rate * 50 * share) * back[d]
    return vectors @ (np.array(output[1]) - np.array(output[0])), bias[1] - bias[0]


def test_training_against_a_plain_version(monkeypatch):
    monkeypatch.setattr(quality, "LEAST_STEPS", 200)
    texts, labels = ["good words here", "BAD!! bad", "fine and good text", "bad bad BAD!!", "words", "!! bad !!"], [1, 0, 1, 0, 1, 0]
    weights, bias = quality.train(pa.array(texts), np.array(labels))
    want, want_bias = plain_training(texts, labels)
    used = sorted({b for t in texts for b in plain_features(t)})
    assert np.allclose(weights[used], want[used], atol=1e-3) and math.isclose(bias, want_bias, abs_tol=1e-3)
    assert np.allclose(weights, want, atol=1e-3) and want[used].std() > 0.1


def test_long_texts_score_like_short_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=quality.BUCKETS).astype(np.float32)
    text = pa.array([" ".join("".join(rng.choice(list("abcé"), rng.integers(1, 9))) for _ in range(3000))])
    whole = quality.mean_weights(text, weights)[0]
    monkeypatch.setattr(quality, "CHUNK", 100)
    assert math.isclose(quality.mean_weights(text, weights)[0], whole, rel_tol=1e-6)


def test_training_takes_a_bounded_sample(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    docs = made(spark, [(i, "w" * (500 if i % 10 == 0 else 10), None) for i in range(100)])
    first = sorted(r.doc_id for r in quality.training_rows(docs, labels, 20).collect())
    assert len(first) == 20 and first == sorted(r.doc_id for r in quality.training_rows(docs.repartition(5), labels, 20).collect())
    assert all(zlib.crc32(str(i).encode()) % 5 for i in first)
    monkeypatch.setattr(quality, "TRAIN_BYTES", 1_000)
    assert sum(len(r.text) for r in quality.training_rows(docs, labels).collect()) <= 1_000


# Operator 4


def brute_top(rows, k):
    good = {i: [math.floor(64 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in good:
        if q % 20 == 0:
            score = {i: sum(a * b for a, b in zip(good[q], good[i], strict=False)) for i in good if i != q}
            found = sorted((-min(max(s, -(1 << 63)), (1 << 63) - 1), i) for i, s in score.items())[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("n", "block"), [(300, 16), (15, 1024), (0, 8)])
def test_top_k(spark, monkeypatch, n, block):
    monkeypatch.setattr(knn_join, "BLOCK", block)
    monkeypatch.setattr(knn_join, "QUERY_BLOCK", block)
    monkeypatch.setattr(knn_join, "CELL_SAMPLE", block)
    monkeypatch.setattr(knn_join, "SAMPLE", block)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * rng.choice([0.1, 1.0])]) for i in range(n)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)] if n else []
    rows += [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6)] if n else []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cell": F.lit(1), "norm": F.lit("x")})
    got = knn_join.top_k(df, F.col("vec_id") % 20 == 0, pivots=5)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 20)


def clustered(n: int, clusters: int, dim: int = 16) -> list:
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(0, clusters, n)] + 0.02 * rng.normal(size=(n, dim))
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def test_top_k_of_clusters_copies_little(spark, monkeypatch):
    """Tight clusters: many query groups, and a vector goes to few of them."""
    monkeypatch.setattr(knn_join, "QUERY_BLOCK", 64)
    monkeypatch.setattr(knn_join, "BLOCK", 128)
    monkeypatch.setattr(knn_join, "COPY_COST", 1)
    seen = []
    before = knn_join._chosen
    monkeypatch.setattr(knn_join, "_chosen", lambda *a: seen.append(before(*a)) or seen[-1])
    rows = clustered(2000, 12)
    got = knn_join.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 20)
    x = np.floor(64 * np.array([v for _, v in rows], np.float64))
    assert len(seen[0].queries) > 3 and seen[0].needs(x).mean() < 0.6


@pytest.mark.parametrize("vector", [[], [3e6, -2.5], [0.25] * 3000])
def test_top_k_odd_vectors(spark, vector):
    rows = [(i, vector) for i in range(30)] + [(40, [1.0]), (60, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, knn_join.top_k(df, F.col("vec_id") % 20 == 0, k=5).collect())) == brute_top(rows, 5)


@pytest.mark.parametrize("pivots", [None, 4])
def test_top_k_of_components_beyond_a_long(spark, pivots):
    rng = np.random.default_rng(6)
    scale = [1.0, 1.0, 1e3, 3e7, 1e9, 1e15, 1e30, 3e38]
    rows = [(i, [float(np.float32(x)) for x in np.clip(rng.normal(size=5), -1, 1) * rng.choice(scale)]) for i in range(200)]
    rows += [(200, [1e30] + [0.0] * 4), (220, [-1e30] + [0.0] * 4), (221, [0.0, 1.0, 0.0, 0.0, 0.0]), (240, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, knn_join.top_k(df, F.col("vec_id") % 20 == 0, pivots=pivots).collect())) == brute_top(rows, 20)
    doubles = spark.createDataFrame([(0, [1e300, 1.0]), (20, [2.0, 1.0]), (1, [1e100, -1e100])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in knn_join.top_k(doubles, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 1, (1 << 63) - 1)]


def test_words_agree():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x0bb c d") == ["a", "b c", "d"]

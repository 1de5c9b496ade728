"""Operator 11: recall, scores and ranks against brute force."""

from functools import reduce
from operator import add

import numpy as np
import pytest

from quizmill.llm import cross_polytope
from quizmill.llm.common import table
from tests.llm.brute import DATA


def truth(ids, x, k, queries):
    """query -> [(vec_id, score)] by the sum of products in order."""
    out = {}
    for at in queries:
        score = np.zeros(len(x))
        for i in range(x.shape[1]):
            score += x[at, i] * x[:, i]
        order = [j for j in np.lexsort((ids, -score)) if j != at][:k]
        out[int(ids[at])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def compared(df, ids, x, k, queries):
    """Recall, after a check that scores are exact and ranks in order."""
    want, where, got = truth(ids, x, k, queries), {int(i): n for n, i in enumerate(ids)}, {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, min(k, len(ids) - 1) + 1))
        assert [r[1:] for r in rows] == sorted((r[1:] for r in rows), key=lambda r: (-r[1], r[0])) and len({r[1] for r in rows}) == len(rows)
        for _, vec_id, score in rows:
            assert vec_id != q and score == reduce(add, (x[where[q]] * x[where[vec_id]]).tolist(), 0.0)
    return float(np.mean([len({v for v, _ in want[q]} & {r[1] for r in got[q]}) / len(want[q]) for q in want]))


def framed(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("folder", [DATA, "/root/testdata/sf0.1"])
def test_recall_of_the_query(spark, folder):
    rows = table(spark, folder, "embeddings").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    assert compared(cross_polytope.query(spark, folder), ids, x, 20, np.flatnonzero(ids % 20 == 0)) >= 0.9


@pytest.mark.parametrize("bucket_rows, rotations", [(10_000, 1), (20, 2)])
def test_clusters_lengths_and_hot_buckets(spark, monkeypatch, bucket_rows, rotations):
    monkeypatch.setattr(cross_polytope, "BLOCK", 100)
    monkeypatch.setattr(cross_polytope, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 10))[rng.integers(0, 12, 900)] + 0.2 * rng.normal(size=(900, 10))
    x[:300] = x[0] + 0.001 * rng.normal(size=(300, 10))
    x[300:330] = x[0]
    x *= rng.uniform(0.5, 2, 900)[:, None]
    ids = rng.permutation(3_000)[:900]
    made = []
    monkeypatch.setattr(cross_polytope, "calibrated", lambda *a, f=cross_polytope.calibrated: made.append(f(*a)) or made[-1])
    recall = compared(cross_polytope.nearest(framed(spark, ids, x), "vec_id % 5 = 0", 7, bucket_rows=bucket_rows), ids, x, 7, np.flatnonzero(ids % 5 == 0))
    assert recall >= 0.9 and made[0][0].rotations <= rotations


def test_defined_cases(spark):
    big = [(20, [1e30, 0.0]), (40, [1e-30, 1.0]), (3, [-1.0]), (4, [2.0, 1.0]), (5, [2.0, 1.0])]
    out = [(None, [1.0, 1.0]), (60, None), (80, []), (100, [0.0, 0.0]), (120, [None, 1.0]), (140, [float("nan"), 1.0]), (160, [float("inf"), 1.0])]
    vectors = spark.createDataFrame(big + out, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS t", "1 AS bucket", "2 AS rank", "3 AS query_id")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in cross_polytope.nearest(vectors, "vec_id % 20 = 0").collect())
    assert got == [
        (20, 1, 4, 2e30), (20, 2, 5, 2e30), (20, 3, 40, 1.0), (20, 4, 3, -1e30),
        (40, 1, 4, 1.0 + 2e-30), (40, 2, 5, 1.0 + 2e-30), (40, 3, 20, 1.0), (40, 4, 3, -1e-30),
    ]
    assert cross_polytope.nearest(vectors.where("false"), "vec_id % 20 = 0").count() == 0
    assert cross_polytope.nearest(vectors.where("vec_id = 20"), "vec_id % 20 = 0").count() == 0
    assert cross_polytope.nearest(vectors.where("vec_id in (3, 4)"), "vec_id % 20 = 0").count() == 0
    huge = spark.createDataFrame([(20, [1e300, 1e300]), (21, [1e300, -1e300]), (22, [1e300, 1e300])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in cross_polytope.nearest(huge, "vec_id = 20").collect()] == [(22, float("inf")), (21, float("-inf"))]


def test_probes_come_in_order_and_reach_every_bucket():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 20))
    tables = cross_polytope.Tables(20, float(np.sqrt((x**2).sum(axis=1)).max()), 2, 3)
    which, code = tables.probes(x[:2], tables.all_buckets())
    assert which.shape[1] == tables.all_buckets() and all(len(set(zip(w, c, strict=True))) == len(w) for w, c in zip(which.tolist(), code.tolist(), strict=True))
    few = tables.probes(x[:2], 50)
    assert (few[0] == which[:, :50]).all() and (few[1] == code[:, :50]).all()
    plain = np.linalg.norm(tables._coordinates(tables._unit(x, True), 1, 0), axis=1)
    assert np.allclose(plain, np.sqrt(2))

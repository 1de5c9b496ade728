import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quizmill.llm import components, exact_dedup, jaccard_join
from quizmill.llm.common import Scratch

from . import brute

EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "One two\nthree four"), (8, "a b c d e"), (9, "a b c d e f"), (10, "é ü ß ñ œ x"), (11, "é ü ß  ñ œ x")]


def made(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"n": F.lit(1), "node": F.lit("x"), "digest": F.lit(2), "label": F.lit(None).cast("int"), "bytes": F.lit(3)})


def near_rows(seed: int, groups: int = 12) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 9, 14, 40, 150, 600]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy += passage
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    return rows


@pytest.mark.parametrize("rows", [EDGE, near_rows(1), near_rows(2, 40), []])
def test_near_components(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(made(spark, rows)).collect()}
    assert got == brute.near_components(rows)


def test_near_components_with_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT_LEAST", 2)
    rows = near_rows(3, 40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(made(spark, rows)).collect()}
    assert got == brute.near_components(rows)


def test_near_components_on_documents(spark):
    docs = spark.read.parquet(f"{brute.DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute.near_components(rows)


def test_near_keeps_one_of_each(spark):
    rows = near_rows(4)
    kept = jaccard_join.one_per_component(made(spark, rows))
    assert kept.columns == made(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute.near_components(rows).values()}


def test_repeated_rows_are_alike(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")]
    assert sorted(map(tuple, jaccard_join.jaccard_components(made(spark, rows)).collect())) == [(1, 3, 1), (1, 3, 1), (2, 3, 1)]


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_groups(spark, digest_bytes):
    rows = EDGE + [(20 + i, t) for i, t in enumerate(["x y", "xy", " x y", "x  y", "z"] * 30)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(made(spark, rows), digest_bytes).collect()}
    assert got == brute.exact_groups(rows)


def test_exact_empty_and_repeated(spark):
    assert exact_dedup.exact_dedup(made(spark, [])).count() == 0
    got = exact_dedup.exact_dedup(made(spark, [(1, "a"), (1, "a"), (2, " a"), (3, None)])).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 2, 3, False), (1, 2, 3, False), (2, 2, 3, True), (3, 3, 1, True)]
    kept = exact_dedup.kept_documents(made(spark, [(1, "a"), (2, "a"), (3, "b")]))
    assert {r.doc_id for r in kept.collect()} == {1, 3}


def test_rows_without_id(spark):
    rows = [(None, "a b c d e f"), (1, "a b  c d e f"), (None, "z y x w v u"), (None, "z y x w v u"), (2, None)]
    got = exact_dedup.exact_dedup(made(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [(0, 0, 2, True), (0, 0, 2, True), (0, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True)]
    assert exact_dedup.kept_documents(made(spark, rows)).count() == 5
    assert jaccard_join.one_per_component(made(spark, rows)).count() == 5


def test_index_grows_by_runs(spark):
    index = exact_dedup.DigestIndex(spark)
    index.flush(made(spark, [(5, "a b"), (6, "c")]))
    index.flush(made(spark, [(3, "ab")]))
    assert {(r.keep_id, r.group_size, r.first_id) for r in index.compact().collect()} == {(5, 2, 3), (6, 1, 6)}
    index.flush(made(spark, [(2, " a b "), (1, "d")]))
    index.compact()
    assert [(r.keep_id, r.points, r.group_size, r.first_id) for r in index.find(["ab"]).collect()] == [(2, 5, 3, 2)]
    assert index.find(["nothing"]).count() == 0


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_no_row_is_lost_without_ids(spark, digest_bytes):
    rng = random.Random(9)
    rows = [(None if i % 19 == 0 else i, rng.choice("abcdefgh") * rng.randint(0, 60) + " " * (i % 3)) for i in range(950)]
    got = exact_dedup.exact_dedup(made(spark, rows), digest_bytes).collect()
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t.replace(" ", ""), []).append((i is None, -len(t), i))
    want = sorted((i or -1, min(g, key=lambda x: x[:2] + (x[2] or 0,))[2] or -1, len(g)) for g in groups.values() for _, _, i in g)
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size) for r in got) == want


def test_exact_long_texts(spark):
    long = "word " * 400_000
    rows = [(1, long), (2, long + "x"), (3, long.replace(" ", "\n") + "\n"), (4, "y")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(made(spark, rows)).collect()}
    assert got == brute.exact_groups(rows)


def long_and_template_rows() -> list[tuple[int, str]]:
    """Sets over 5,000 shingles on both sides of the threshold; one template with own parts of a quarter; two groups that almost meet."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    base = [word() for _ in range(6000)]
    for changed in (0, 40, 110, 128, 134, 140, 300):
        copy = list(base)
        for at in rng.sample(range(0, 6000, 6), changed):
            copy[at] = word()
        texts.append(copy)
    template = [word() for _ in range(120)]
    texts += [template + [word() for _ in range(40)] for _ in range(60)]
    one, two = [word() for _ in range(90)], [word() for _ in range(22)]
    texts += [one + [word() for _ in range(4)] for _ in range(60)] + [one[:78] + two + [word() for _ in range(2)] for _ in range(60)]
    return [(3 * i + 1, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("least", [30, 2])
def test_near_components_of_long_texts_and_templates(spark, monkeypatch, least):
    monkeypatch.setattr(jaccard_join, "FREQUENT_LEAST", least)
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 16)
    monkeypatch.setattr(jaccard_join, "GROUP_BYTES", 1 << 14)
    rows = long_and_template_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(made(spark, rows)).collect()}
    assert got == brute.near_components(rows)


@pytest.mark.parametrize("run", [200_000, 3])
def test_components_of_chains(spark, monkeypatch, run):
    monkeypatch.setattr(components, "RUN", run)
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 130), (130, 115)] + [(200, 200)]
    random.Random(1).shuffle(links)
    got = components.components(spark.createDataFrame(links, "u long, v long").repartition(5), Scratch(spark, "test"))
    assert {(r.node, r.label) for r in got.collect()} == {(i, 1) for i in range(2, 61)} | {(115, 100), (130, 100)}


def test_frequent_shingles_are_counted_over_all_documents(spark):
    """A passage in 40 documents, each in a task of its own and so once in every run, is listed; one in 30 is not."""
    passage, rarer = (" ".join(f"{kind}{i}" for i in range(12)) for kind in "pr")
    rows = [(i, f"{passage} {rarer if i < 30 else ''} " + " ".join(f"own{i}x{k}" for k in range(30))) for i in range(40)] + [(100, None), (101, ""), (102, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows), "doc_id")
    listed = jaccard_join.Frequent(*jaccard_join._frequent(docs.select("text"), 40 * 50))
    (_, common), (_, less), (_, own) = jaccard_join.shingle_sets(pa.array([passage, rarer, " ".join(f"own3x{k}" for k in range(30))]))
    assert listed.of(common).tolist() == [40] * 8
    assert not listed.of(less).any() and not listed.of(own).any()


def test_counts_of_buckets_agree_with_a_plain_count():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 64, 400, np.uint64) & np.uint64(0xFFF0000000000FFF)) for _ in range(60)]
    plain = Counter(int(x >> np.uint64(44)) for s in sets for x in s)
    rows = [jaccard_join._bucket_counts_of(sets[k : k + 7], 20, 8).to_pandas() for k in range(0, 60, 7)]
    got = {}
    for _, pdf in pd.concat(rows).groupby("slice"):
        found = jaccard_join._often(8, 2)(pdf)
        got |= dict(zip(found["bucket"].tolist(), found["times"].tolist(), strict=True))
    assert got == {k: n for k, n in plain.items() if n > 2}


@pytest.mark.parametrize(("parts", "most"), [(12, 6.5), (2_000, 12)])
def test_keys_of_many_parts_stay_small(parts, most):
    """Before, every set of a part took 12 bytes besides its keys' 6, and at 2,000 parts each key has a set of its own."""
    rng = np.random.default_rng(3)
    sets, keys, plain = [], [], Counter()
    for tag in rng.integers(0, 1 << 63, 300, np.uint64).tolist():
        for slot in (0, 1):
            need, own = jaccard_join.wire_keys(rng.integers(0, 1 << 64, 120, np.uint64), 60 + tag % 9, parts)
            sets.append((tag, slot, need))
            keys.append(own)
            plain.update((k >> 32, k & 0xFFFFFFFF, tag >> 24 & 0xFFFFFFFFFF, slot, need) for k in own.tolist())
    rows = jaccard_join._packed(sets, keys, parts)
    assert sum(len(b) for b in rows["packed"].to_pylist()) < most * sum(len(k) for k in keys) + 60 * rows.num_rows
    got = Counter()
    for part, blob in zip(rows["part"].to_pylist(), rows["packed"].to_pylist(), strict=True):
        tag, table, key = jaccard_join._unpacked(blob)
        own = np.repeat(np.arange(len(table)), table["times"])
        got.update(zip([part] * len(key), key.tolist(), tag[own].tolist(), table["slot"][own].tolist(), table["need"][own].tolist(), strict=True))
    assert got == plain


def test_keys_that_fall_together_lower_the_need():
    keys = np.array([5 << 32 | 12, 5 << 32 | 24, 6 << 32 | 12], np.uint64)  # the first two are one in 12 parts
    assert [(n, len(k)) for n, k in (jaccard_join.wire_keys(keys, need, 12) for need in (3, 1))] == [(2, 2), (1, 2)]


def test_blocks_of_the_same_members_are_compared_once(spark):
    rows = [(b, node, 10 * node, node, False) for b in range(50) for node in (1, 2, 3)] + [(60, node, 10 * node, node, node == 3) for node in (1, 2, 3)] + [(61, 1, 10, 1, False), (61, 2, 20, 2, False)]
    members = spark.createDataFrame(rows, "block long, node long, n long, label long, probe boolean")
    got = {}
    for r in jaccard_join._one_of_alike(members, Scratch(spark, "test")).collect():
        got.setdefault(r.block, []).append((r.node, r.n, r.probe))
    assert sorted(map(sorted, got.values())) == [[(1, 10, False), (2, 20, False)], [(1, 10, False), (2, 20, False), (3, 30, False)], [(1, 10, False), (2, 20, False), (3, 30, True)]]

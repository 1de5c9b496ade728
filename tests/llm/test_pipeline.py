from pyspark.sql import functions as F

import corpus_pipeline
from quizmill.llm import mixing, quality

from . import brute


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{brute.DATA}/documents.parquet")
    labels = spark.read.parquet(f"{brute.DATA}/labels.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, brute.DATA)
        docs = docs.persist()
        out[name] = (before, docs)
        if name != "length_bucket_packing":
            assert docs.columns == before.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    texts = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    before, after = out["quality_classifier"]
    assert ids(after) == ids(quality.classify(before, labels).where("predicted = 1"))
    assert after.count() <= before.count()
    before, after = out["exact_dedup"]
    assert ids(after) == {keep for keep, _, _ in brute.exact_groups(texts(before)).values()}
    before, after = out["ngram_jaccard_join"]
    assert ids(after) == {c for _, c in brute.near_components(texts(before)).values()}
    before, after = out["mix_sources"]
    want = {r.doc_id: r.taken // r.size for r in mixing.mix(before).collect() if r.size}
    got: dict = {}
    for i, t in texts(after):
        if brute.WORD.findall(t or ""):
            got[i] = got.get(i, 0) + 1
    assert got == {i: n for i, n in want.items() if n}
    before, after = out["length_bucket_packing"]
    assert sorted((r.doc_id, r.n_tokens) for r in after.collect()) == sorted((i, len(brute.WORD.findall(t or ""))) for i, t in texts(before))
    assert {r.doc_id: 1 for r in corpus_pipeline.run(spark, brute.DATA).collect()} == {r.doc_id: 1 for r in after.collect()}


def test_stages_carry_any_columns_and_no_rows(spark):
    """Nulls, empty texts, repeated rows and columns with the operators' own names through all five stages."""
    names = ("size", "rate", "keep_id", "digest", "component_id", "node", "label", "bytes", "row", "copies", "bucket_len", "_dropped", "held_out", "score")
    rows = [(1, "a b c d e f g", "s"), (1, "a b c d e f g", "s"), (2, "a b c d  e f g", None), (3, None, None), (4, "", "s"), (None, "x", "s"), (5, "a b c d e f g h", "t"), (6, "w " * 50_000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, brute.DATA), stage(spark, empty, brute.DATA)
        assert empty.count() == 0, name
        if name != "length_bucket_packing":
            assert docs.columns[:3] == ["doc_id", "text", "source"] and set(names) <= set(docs.columns), name
            found = docs.collect()
            assert found and all(r[n] == k for r in found for k, n in enumerate(names)), name
    assert {r.n_tokens for r in docs.collect()} <= {0, 1, 7, 8, 50_000}

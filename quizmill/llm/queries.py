"""Queries of the corpus operators and, where SQL expresses them, their SQL."""

from __future__ import annotations

from quizmill.llm import cross_polytope, divergence, exact_dedup, jaccard_join, knn_join, merkle, mixing, packing, pii, quality, repeats, secrets, warc

QUERIES = {
    "op1_remove_repeats": repeats.query,
    "op2_length_bucket_packing": packing.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_voronoi_top_k": knn_join.query,
    "op5_secret_scan": secrets.query,
    "op6_quality_classifier": quality.query,
    "op7_mix_sources": mixing.query,
    "op8_warc_normaliser": warc.query,
    "op9_ngram_jaccard_join": jaccard_join.query,
    "op10_pii_anchor_expansion": pii.query,
    "op11_cross_polytope": cross_polytope.query,
    "op12_source_divergence": divergence.query,
    "op13_merkle_manifest": merkle.query,
}

SQL = {
    "op1_remove_repeats": repeats.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_voronoi_top_k": knn_join.SQL,
    "op7_mix_sources": mixing.SQL,
    "op8_warc_normaliser": warc.SQL,
    "op9_ngram_jaccard_join": jaccard_join.SQL,
    "op12_source_divergence": divergence.SQL,
}

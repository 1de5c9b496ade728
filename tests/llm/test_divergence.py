"""Operator 12 against a plain version of the audit."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quizmill.llm import divergence
from tests.llm.brute import DATA, UPPER

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=30, ranks=50):
    frequencies, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        own = TERM.findall((text or "").translate(UPPER))
        frequencies[lang or ""].update(set(own))
        counts[lang or "", source or ""].update(own)
        groups[lang or ""].add(source or "")
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in frequencies[lang].items() if n >= least]

        def shares(of, kept=kept):
            total = sum(of[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (of[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)}
            above = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(above[:ranks])}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    want = brute([tuple(r) for r in docs.collect()])
    assert found(divergence.audit(docs)) == want and {r[2] for r in want} == {"pair", "term"}


@pytest.mark.parametrize("least, slice_bytes, block_terms, block_sources", [(2, 40, 3, 2), (3, 1_000, 5, 100), (1, 7, 1, 1)])
def test_slices_blocks_and_sides(spark, least, slice_bytes, block_terms, block_sources):
    dice = random.Random(5)
    words = ["a", "B", "ab", "ba", "aba", "é", "É", "漢字", "x1y", "tail-end", "Straße", "ß", "İ"]
    rows = [(k, dice.choice(" \n.,") .join(dice.choices(words, k=dice.randrange(12))), dice.choice(["en", "de", None, ""]), f"s{dice.randrange(7)}" if dice.random() < 0.9 else None) for k in range(120)]
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), least, 4, slice_bytes, block_terms, block_sources)
    assert found(got) == brute(rows, least, 4)


def test_defined_cases(spark):
    rows = [(1, None, None, None), (1, "", "", "b"), (None, "word " * 50_000, "en", "a"), (2, "Word wörd", "en", "b"), (2, "Word wörd", "en", "b"), (3, "alone", "fr", "only"), (4, "0 1 _ [ ]", "xx", "y"), (5, "@", "xx", "z")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'k' AS term", "2 AS kept", "3 AS value", "4 AS rank")
    assert found(divergence.audit(docs, least=2)) == brute(rows, 2)
    assert found(divergence.audit(docs, least=9)) == brute(rows, 9)
    assert found(divergence.audit(docs.where("false"))) == set()
    assert ("xx", "y", "pair", "z", 0, 1) in brute(rows, 2)


def test_counts_beyond_a_long_product(spark):
    df = spark.range(1).select(divergence.share(*[divergence.F.lit(n).cast("long") for n in (4 * 10**17, 10**18, 10**6)]).alias("p"))
    assert df.first()["p"] == 1 + 10**9 * (4 * 10**17 + 5) // (10**18 + 5 * 10**6)

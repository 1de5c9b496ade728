"""Operator 13 against a plain version of the manifest."""

import hashlib
import zlib

import pytest

from quizmill.llm import merkle
from tests.llm.brute import DATA

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest(*["-" if v is None else f"{len(v.encode())}:{v}" for v in fields])


def tree(nodes):
    """(root, for each node the list of (run, place) up to the root)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, place in enumerate(at):
            paths[k].append((runs[place // 3], place % 3))
        at, nodes = [place // 3 for place in at], [digest(*run) for run in runs]
    return nodes[0], paths


def brute(rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0], leaf(*r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[1] for x in sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]) for s in sources}
    root, over = tree([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for (doc_id, own, r), path in zip(sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), trees[s][1], strict=True):
            text = r[1]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node, others = leaf(r[0], text, *r[2:]), ""
            for run, place in path + over[k]:
                others += "".join(run[:place] + run[place + 1 :])
                node = digest(*run[:place], node, *run[place + 1 :])
            out.append((doc_id, own, trees[s][0], root, digest(others), node, node == root))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_manifest_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    assert found(merkle.manifest(docs)) == want
    assert 0 < sum(not r[-1] for r in want) < len(want)


@pytest.mark.parametrize("height, top_nodes", [(1, 4), (2, 10), (1, 1), (6, 1)])
def test_blocks_and_subroots_in_several_rounds(spark, height, top_nodes):
    rows = [(k, f"a\nb {k}" if k % 3 else f"c {k}", "en", f"s{k % 7}" if k % 2 else "hot", k) for k in range(130)]
    rows += [(1_000 + k, "x\ny", None, f"lone{k:02}", None) for k in range(15)]
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), height, top_nodes)) == brute(rows)


def test_defined_cases(spark):
    rows = [
        (None, None, None, None, None),
        (None, "a\nb", "en", None, 1),
        (5, "", "", "", 0),
        (5, None, "", "", 0),
        (7, "é\n漢", "fr", "é", 3),
        (7, "é\n漢", "fr", "é", 3),
        (-3, "line\n" * 20_000, "en", "z", 100_000),
        (8, "\n", "en", "🂡", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS node", "1 AS at", "'y' AS tree", "'z' AS leaf", "0 AS count")
    assert found(merkle.manifest(docs)) == brute(rows)
    assert found(merkle.manifest(docs.where("false"))) == []
    assert found(merkle.manifest(docs.where("doc_id = 8"))) == brute(rows[-1:])
    one = found(merkle.manifest(docs.where("doc_id = 8")))[0]
    assert one[1] == one[2] == one[3] and one[4] == digest()

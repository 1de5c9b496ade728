"""Operator 13, Merkle dataset manifest: broadcast upper tree.

Leaves are digested in the scan, put in order by source and doc_id, and numbered
within their source. Blocks of ``3 ** HEIGHT`` consecutive leaves are reduced to
one node each inside tasks, again and again, until few nodes are left; the driver
builds the top tree over those, and broadcasts for each of them the path from it
to the root. Tasks then take their blocks up once more: a row's proof is its path
inside its block followed by the block's path, and every row is folded along it.
Only digests are shuffled, never texts, and a block is the most that a task holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizmill.llm.common import Scratch, table

#: Nodes of a run, and levels that a block has: 729 leaves.
FANOUT, HEIGHT = 3, 6
#: Nodes of the top tree at most; each has a path of about 1.5 KB, so that the broadcast is below 16 MB.
TOP_NODES = 8_192

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(**changed: Column) -> Column:
    """The leaf of a row: every field as '-' or its byte count, ':' and value."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.encode(F.concat(*[field(f) for f in FIELDS]), "utf-8"), 256)


def tampered_text() -> Column:
    """The text without newlines where the id's checksum is even, as it is elsewhere."""
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 2 == 0
    return F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))


def levels_of(nodes: list[str], count: int, height: int) -> list[list[str]]:
    """A block's nodes level by level, up to its root, in a tree of ``count`` nodes at the lowest level."""
    out = [nodes]
    while len(out) <= height and count > 1:
        last = out[-1]
        out.append([digest(last[i : i + FANOUT]) for i in range(0, len(last), FANOUT)])
        count = -(-count // FANOUT)
    return out


def path_in(levels: list[list[str]], at: int) -> tuple[str, str]:
    """(shape, siblings) from a node to the block's root: two digits a level (place in the run, size of the run), and the run's others."""
    shape, others = [], []
    for level in levels[:-1]:
        start = at - at % FANOUT
        run = level[start : start + FANOUT]
        shape.append(f"{at - start}{len(run)}")
        others += run[: at - start] + run[at - start + 1 :]
        at //= FANOUT
    return "".join(shape), "".join(others)


def fold(node: str, shape: str, siblings: str) -> str:
    """The root that a node leads to along a path."""
    at, width = 0, len(node)
    for k in range(0, len(shape), 2):
        place, size = int(shape[k]), int(shape[k + 1])
        middle, end = at + place * width, at + (size - 1) * width
        node = digest([siblings[at:middle], node, siblings[middle:end]])
        at = end
    return node


def _blocks(batches: Iterator[pa.RecordBatch], height: int):
    """((tree, block), rows) of consecutive rows (tree, at, count, node, …) of one block; rows of a block never leave their task."""
    size, key, rows = FANOUT**height, None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            own = (row[0], row[1] // size)
            if own != key:
                if rows:
                    yield key, rows
                key, rows = own, []
            rows.append(row)
    if rows:
        yield key, rows


def _split(rows: list[tuple]) -> tuple[tuple | None, list[tuple]]:
    """(the block's path if it travels with the rows, the rows themselves)."""
    return (rows[0], rows[1:]) if rows[0][3] is None else (None, rows)


def _reduced(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (tree, block), rows in _blocks(batches, height):
            count = rows[0][2]
            top = levels_of([r[3] for r in rows], count, height)[-1]
            out.append((tree, block, -(-count // FANOUT**height), top[0]))
        yield _batch(out, ["tree", "at", "count", "node"], [pa.string(), pa.int64(), pa.int64(), pa.string()])

    return run


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _with_paths(height: int, sent, last: bool):
    """Paths to the root for every node of a level, or, at the last level, the rows' proofs and folds.

    ``sent`` is the broadcast (tree, block) -> (shape, siblings, subroot, root), or None if a
    block's path comes as its first row (its ``node`` is null).
    """
    names = [c.split()[0] for c in RESULT.split(", ")] if last else ["tree", "at", "shape", "siblings", "subroot", "root"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()] if last else [pa.string(), pa.int64(), *[pa.string()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, rows in _blocks(batches, height):
            first, rows = _split(rows)
            shape, siblings, subroot, root = sent.value[key] if first is None else first[4:8]
            levels = levels_of([r[3] for r in rows], rows[0][2], height)
            for at, row in enumerate(rows):
                own_shape, own = path_in(levels, at)
                own_shape, own = own_shape + shape, own + siblings
                if last:
                    folded = fold(row[9], own_shape, own)
                    out.append((row[8], row[3], subroot, root, digest([own]), folded, folded == root))
                else:
                    out.append((row[0], row[1], own_shape, own, subroot, root))
            if len(out) >= 2_000:
                yield _batch(out, names, kinds)
                out = []
        yield _batch(out, names, kinds)

    return run


def _dealt(rows: DataFrame, height: int) -> DataFrame:
    """A level's rows, every block in one task and in order, its path (if any) first."""
    block = F.floor(F.col("at") / FANOUT**height)
    return rows.repartition("tree", block).sortWithinPartitions("tree", block, F.col("node").isNotNull(), "at")


def numbered(rows: DataFrame, scratch: Scratch, name: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their place within their tree, and ``count``, its size.

    Rows are dealt by range, so a large tree is spread over tasks; a place is the rows of
    the tree in earlier ranges plus the place within the range.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("serial", F.monotonically_increasing_id())
    ranged = scratch.written(ranged.withColumn("piece", F.shiftright("serial", 33)), f"{name}-ranged")
    pieces = ranged.groupBy("tree", "piece").agg(F.min("serial").alias("start"), F.count("*").alias("size"))
    before = Window.partitionBy("tree").orderBy("piece")
    pieces = pieces.withColumn("first", F.sum("size").over(before) - F.col("size")).withColumn("count", F.sum("size").over(Window.partitionBy("tree")))
    pieces = scratch.written(pieces.drop("size"), f"{name}-pieces")
    out = ranged.join(pieces, ["tree", "piece"]).withColumn("at", F.col("serial") - F.col("start") + F.col("first"))
    return scratch.written(out.drop("serial", "piece", "start", "first"), name)


def top_paths(nodes: list[tuple]) -> dict[tuple, tuple]:
    """(tree, at) -> (shape, siblings, subroot, root) over the nodes left (tree, at, count, node); trees in order of their names."""
    trees: dict[str, list[str]] = {}
    for tree, _, _, node in sorted(nodes):
        trees.setdefault(tree, []).append(node)
    inner = {tree: levels_of(of, len(of), len(of)) for tree, of in trees.items()}
    roots = [levels[-1][0] for levels in inner.values()]
    outer = levels_of(roots, len(roots), len(roots))
    out = {}
    for k, (tree, levels) in enumerate(inner.items()):
        over = path_in(outer, k)
        for at in range(len(levels[0])):
            own = path_in(levels, at)
            out[tree, at] = (own[0] + over[0], own[1] + over[1], roots[k], outer[-1][0])
    return out


def manifest(docs: DataFrame, height: int = HEIGHT, top_nodes: int = TOP_NODES) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one row for each row of ``docs``.

    ``docs`` needs doc_id, source, lang, n_chars and text; other columns are ignored.
    A null field is '-' in its leaf, an empty text is '0:'; texts are digested whole.
    Rows without source form a tree of their own, the first. Rows without doc_id come
    first in their source and are not tampered with; rows with one doc_id go by their
    leaf, and repeated rows are leaves each, with the same leaf and proofs of their own.
    A source of one row has its leaf as subroot; one source alone has its subroot
    as root. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    fields = docs.select(*[F.col(c).cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS])
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))  # null first, then by UTF-8 bytes
    leaves = fields.select(tree.alias("tree"), "doc_id", leaf_of().alias("node"), leaf_of(text=tampered_text()).alias("tampered"))
    leaves = numbered(scratch.written(leaves, "leaves"), scratch, "numbered", ["doc_id", "node", "tampered"])
    # Upwards: blocks become nodes until few are left.
    ups: list[tuple[DataFrame, DataFrame | None]] = []
    nodes, renamed = leaves.select("tree", "at", "count", "node"), None
    while True:
        ups.append((nodes, renamed))
        reduced = _dealt(nodes, height).mapInArrow(_reduced(height), "tree string, at long, count long, node string")
        nodes, renamed = scratch.written(reduced, "nodes"), None
        found = nodes.agg(F.count("*").alias("nodes"), F.max("count").alias("most")).first()
        if found["nodes"] <= top_nodes:
            break
        if found["most"] == 1:  # more sources than the driver takes: their subroots are the leaves of one tree
            subroots = numbered(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), scratch, "subroots", ["source"])
            renamed = subroots.select("source", "at", F.col("node").alias("subroot"))
            nodes = subroots.select("tree", "at", "count", "node")
    paths = top_paths([tuple(r) for r in nodes.select("tree", "at", "count", "node").collect()])  # top_nodes at most
    sent, above = spark.sparkContext.broadcast(paths), None
    # Downwards: paths of the blocks' nodes, then the rows' proofs.
    for level in range(len(ups) - 1, 0, -1):
        below, names = ups[level]
        found = _asked(below, above, height).mapInArrow(_with_paths(height, sent, False), "tree string, at long, shape string, siblings string, subroot string, root string")
        if names is not None:
            found = found.drop("subroot").join(names, "at").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("at"), "shape", "siblings", "subroot", "root")
        above, sent = scratch.written(found, "paths"), None
    rows = _asked(leaves, above, height).mapInArrow(_with_paths(height, sent, True), RESULT)
    result = scratch.written(rows, "manifest")
    scratch.drop(but=(scratch.tables("manifest")[0],))
    return result


def _asked(below: DataFrame, above: DataFrame | None, height: int) -> DataFrame:
    """The rows of a level for ``_with_paths``: tree, at, count, node, shape, siblings, subroot, root, doc_id, tampered."""
    empty = [F.lit(None).cast("string").alias(c) for c in ("shape", "siblings", "subroot", "root")]
    own = [F.col("doc_id"), F.col("tampered")] if "doc_id" in below.columns else [F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered")]
    rows = below.select("tree", "at", "count", "node", *empty, *own)
    if above is not None:
        none = [F.lit(None).cast("long").alias("count"), F.lit(None).cast("string").alias("node")]
        paths = above.select("tree", (F.col("at") * FANOUT**height).alias("at"), *none, "shape", "siblings", "subroot", "root", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("tampered"))
        rows = rows.unionByName(paths)
    return _dealt(rows, height)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))

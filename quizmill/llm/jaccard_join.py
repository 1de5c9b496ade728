"""Operator 9, n-gram Jaccard join by parity sketches.

Every document is its set of distinct five-word shingles. A shingle flips one
bit of a bit sketch, so the Hamming distance of two sketches is at most the
sets' symmetric difference. Two sets of a and b members with Jaccard similarity
of 0.8 or more differ in at most (a + b) / 9 members. Per band of set sizes a
(virtual, sparse) sketch is cut into more blocks than the largest such
difference D, so two linked sets agree on at least one block; blocks meet in a
shuffle on the XOR of their bits' codes. A dense sketch, wider for larger sets,
prunes the pairs by its Hamming distance, and the pairs left are verified on the
exact sets.

An empty block says nothing, so blocks are built from shingles that are not
frequent. A document that has no more than D blocks with content (many of its
shingles are frequent) emits single bits as well, rarest shingles first: of two
linked sets the smaller one's first a / 9 + 1 bits and the larger one's first
b / 5 + 1 bits share one, for the shared part starts no later in either. A pair is
found by blocks if either of its documents has enough of them, else by bits; so the
choice of frequent shingles affects speed only, never the result.

Large groups: equal sets collapse to one node first, and blocks with the same
members to one block. Every block links its members to one centre only; after
the centre links are resolved into components, only pairs across components
remain. Those are compared inside tasks, in tiles of bounded size: first by
sketches, which leaves the members that may have a link at all, then by the exact
sets of these; a tile's output is at most a row per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import Scratch, filter_of, in_filter, mixed, table, without_rows
from quizmill.llm.components import components
from quizmill.llm.shingles import set_tags, shingle_sets

#: Shingles that more documents than this have are frequent.
FREQUENT_LEAST = 30
#: The list of frequent shingles that tasks get: 12 MB at most (the most frequent come first).
FREQUENT_MOST = 1_000_000
#: Buckets that one task counts: 32 MB of counters at most.
SLICE_BITS = 22
#: Words of 64 bits in the smallest dense sketch.
SKETCH_WORDS = 8
#: Shingles per part of the block shuffle; members and bytes of a tile's side.
PART_SHINGLES = 2_000_000
TILE_ROWS, TILE_BYTES = 1_000, 8 << 20
#: Bytes of a group of small blocks.
GROUP_BYTES = 1 << 20

_COUNT_AT = 2_000_000
_EMIT_AT = 1_000_000
_SETS_AT = 8 << 20
#: Slots of a set's keys: blocks of the lower band (0) and of the upper one (1), single bits, and single bits for probing alone.
_BITS, _PROBES = 2, 3
#: Of a set's keys in a part: what their slot is (and whether another set begins here), how many it needs, how many there are.
_SET = np.dtype([("slot", "u1"), ("need", "<u2"), ("times", "<u4")])
_NEXT_SET = 1 << 7


def _band_edges() -> np.ndarray:
    """Rising band edges; sizes a <= b <= 1.25 a lie in one band or in neighbours."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, edges[-1] * 5 // 4))
    return np.array(edges, np.int64)


EDGES = _band_edges()


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its set's identity and size."""
    for batch in batches:
        ids = batch.column(0)
        one, two, size = (np.zeros(len(ids), np.int64) for _ in range(3))
        for i, found in shingle_sets(batch.column(1)):
            tags = set_tags(found)
            one[i], two[i], size[i] = tags[0].view(np.int64), tags[1].view(np.int64), len(found)
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(one), pa.array(two), pa.array(size)], names=["doc_id", "t1", "t2", "n"])


def _bucket_counts_of(sets: list[np.ndarray], bits: int, slice_bits: int) -> pa.RecordBatch:
    """A row per slice of the buckets: the buckets with shingles of the sets, as steps, and how many shingles each has.

    A shingle's bucket is its first ``bits`` bits, a slice has 2 ** slice_bits buckets.
    Steps and counts are small numbers, of which compression leaves about a byte.
    """
    bucket = np.sort(np.concatenate(sets) >> np.uint64(64 - bits)).view(np.int64)
    at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    times = np.diff(np.append(at, len(bucket)))
    bucket = bucket[at]
    part = bucket >> slice_bits
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    blobs = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        both = np.stack([np.diff(bucket[a:b], prepend=bucket[a]), times[a:b]]).astype("<u4")
        blobs.append(pa.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True))
    heads = cuts[:-1]
    return pa.RecordBatch.from_arrays([pa.array(part[heads]), pa.array(bucket[heads]), pa.array(np.diff(cuts)), pa.array(blobs, pa.binary())], names=["slice", "first", "seen", "packed"])


def _bucket_counts(bits: int, slice_bits: int):
    """The rows of ``_bucket_counts_of`` for runs of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            for _, found in shingle_sets(batch.column(0)):
                if len(found):
                    waiting.append(found)
                    held += len(found)
                if held > _COUNT_AT:
                    yield _bucket_counts_of(waiting, bits, slice_bits)
                    waiting, held = [], 0
        if waiting:
            yield _bucket_counts_of(waiting, bits, slice_bits)

    return run


def _often(slice_bits: int, least: int):
    """(bucket, times) of a slice's buckets with more than ``least`` shingles, each counted once a document."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["slice"].iloc[0]) << slice_bits
        total = np.zeros(1 << slice_bits, np.int64)
        for first, seen, blob in zip(pdf["first"].tolist(), pdf["seen"].tolist(), pdf["packed"], strict=True):
            planes = np.frombuffer(pa.decompress(blob, 8 * seen, codec="zstd"), np.uint8).reshape(4, 2 * seen)
            both = np.ascontiguousarray(planes.T).view("<u4").ravel()
            total[first - start + np.cumsum(both[:seen], dtype=np.int64)] += both[seen:]
        often = np.flatnonzero(total > least)
        return pd.DataFrame({"bucket": start + often, "times": total[often]})

    return run


def _frequent(texts: DataFrame, shingles: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits, buckets, times): the buckets of shingles that more than FREQUENT_LEAST documents have, FREQUENT_MOST at most.

    All shingles of all documents are counted, in a bucket for every two to four of
    them, however the documents are dealt to tasks.
    """
    spark = texts.sparkSession
    bits = min(40, max(20, (shingles // 4).bit_length()))
    slice_bits = max(0, min(SLICE_BITS, bits - int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length()))
    counts = texts.mapInArrow(_bucket_counts(bits, slice_bits), "slice long, first long, seen long, packed binary")
    often = counts.groupBy("slice").applyInPandas(_often(slice_bits, FREQUENT_LEAST), "bucket long, times long")
    listed = often.orderBy(F.desc("times"), "bucket").limit(FREQUENT_MOST).toPandas()
    return bits, listed["bucket"].to_numpy(np.uint64), listed["times"].clip(upper=(1 << 32) - 1).to_numpy(np.uint32)


class Frequent:
    """How many documents have the listed shingles, by bucket; 0 for all others."""

    def __init__(self, bits: int, buckets: np.ndarray, times: np.ndarray):
        order = np.argsort(buckets)
        self.values, self.times, self.shift = buckets[order], times[order], np.uint64(64 - bits)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.values >> np.uint64(bits - 20)).astype(np.int64)] = True

    def of(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros(len(found), np.uint32)
        at = np.flatnonzero(self.maybe[(found >> np.uint64(44)).astype(np.int64)])
        if len(at):
            bucket = found[at] >> self.shift
            near = np.minimum(np.searchsorted(self.values, bucket), len(self.values) - 1)
            out[at] = np.where(self.values[near] == bucket, self.times[near], 0)
        return out


def _block_keys(found: np.ndarray, m: int, salt: int) -> np.ndarray:
    """Keys of the sketch's blocks with content: the XOR of the members' codes with the block and family."""
    if not len(found):
        return found
    block = ((found >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with the sorted members
    at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    return mixed(np.bitwise_xor.reduceat(mixed(found, 5), at) ^ mixed(block[at], salt))


def block_keys(found: np.ndarray, times: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(slot, blocks that any linked set shares at least, keys) of one set: blocks of its two bands, and single bits if these are too few."""
    n = len(found)
    band = int(np.searchsorted(EDGES, n, side="right")) - 1
    rare = found[times == 0] if times.any() else found
    out, is_open = [], False
    for k in (band - 1, band):
        if k < 0:
            continue
        most = int(EDGES[k + 2]) - 1
        d = 2 * most // 9
        if not d:
            continue  # sets of this band are linked when equal only
        got = _block_keys(rare, d + 4 + d // 2, 2 * k + 100)
        out.append((int(k == band), max(1, len(got) - d), got))
        is_open |= len(got) <= d
    if is_open:
        order = np.lexsort((found, times))
        bits = mixed(found[order[: n // 5 + 1]], 98)
        out += [(_BITS, 1, bits[: n // 9 + 1]), (_PROBES, 1, bits[n // 9 + 1 :])]
    return [x for x in out if len(x[2])]


def wire_keys(keys: np.ndarray, need: int, parts: int) -> tuple[int, np.ndarray]:
    """(need, keys) as they are sent: a key's part and 32 bits more, which a part's few million keys take to differ.

    Keys of one set that become one count as one: of the blocks that a linked set
    shares, no more can fall together than the set loses.
    """
    sent = np.unique((keys & np.uint64(0xFFFFFF)) % np.uint64(parts) << np.uint64(32) | keys >> np.uint64(32))
    return max(1, need - (len(keys) - len(sent))), sent


def _packed(sets: list[tuple[int, int, int]], keys: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """A row per part: the sets with a key there (a short tag for each, then slot, need and number of keys), and the keys.

    The more parts there are, the fewer keys of a set share its entry, so entries are
    small: a set's slots share its tag, and the other columns, which hardly vary, are compressed.
    """
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in keys])
    key = np.concatenate(keys)
    part = (key >> np.uint64(32)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, owner, key = part[order], owner[order], key[order].astype("<u4")
    table = np.zeros(len(sets), _SET)
    tag, slot, need = (np.array(c, np.uint64) for c in zip(*sets, strict=True))
    short = np.ascontiguousarray((tag >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])
    table["slot"], table["need"] = slot, np.minimum(need, 0xFFFF)
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    names, blobs = [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        heads = np.flatnonzero(np.concatenate(([True], owner[a + 1 : b] != owner[a : b - 1])))
        own = owner[a + heads]
        mine, new = table[own], np.concatenate(([True], tag[own[1:]] != tag[own[:-1]]))
        mine["times"] = np.diff(np.append(heads, b - a))
        mine["slot"] |= new * np.uint8(_NEXT_SET)
        planes = pa.compress(np.ascontiguousarray(mine.view(np.uint8).reshape(-1, _SET.itemsize).T).tobytes(), codec="zstd", asbytes=True)
        names.append(int(part[a]))
        blobs.append(np.array([new.sum(), len(mine), len(planes)], np.uint32).tobytes() + short[own[new]].tobytes() + planes + key[a:b].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "packed"])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tags, entries, keys) of a row of ``_packed``; a tag and an entry for each slot of a set."""
    tags, entries, size = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    wide = np.zeros((tags, 8), np.uint8)
    wide[:, :5] = np.frombuffer(blob, np.uint8, 5 * tags, 12).reshape(-1, 5)
    at = 12 + 5 * tags
    planes = np.frombuffer(pa.decompress(blob[at : at + size], _SET.itemsize * entries, codec="zstd"), np.uint8)
    table = np.ascontiguousarray(planes.reshape(_SET.itemsize, -1).T).view(_SET).ravel()
    tag = wide.view(np.uint64).ravel()[np.cumsum(table["slot"] >= _NEXT_SET) - 1]
    table["slot"] &= _NEXT_SET - 1
    return tag, table, np.frombuffer(blob[at + size :], "<u4")


def _emit_blocks(parts: int, frequent):
    """Per run of documents and part one packed row of block keys with the sets they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = Frequent(*frequent.value)
        sets, keys, seen, held = [], [], set(), 0
        for batch in batches:
            for _, found in shingle_sets(batch.column(0)):
                if len(found) < 4:
                    continue
                tag = int(set_tags(found)[0])
                if (tag, len(found)) in seen:
                    continue
                seen.add((tag, len(found)))
                for slot, need, own in block_keys(found, listed.of(found)):
                    need, own = wire_keys(own, need, parts)
                    sets.append((tag, slot, need))
                    keys.append(own)
                    held += len(own)
                if held > _EMIT_AT:
                    yield _packed(sets, keys, parts)
                    sets, keys, seen, held = [], [], set(), 0
        if keys:
            yield _packed(sets, keys, parts)

    return run


def _shared_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one part that at least two different sets share: (block, tag, slot, need, copies, others).

    A block is named by its members, so that blocks with the same ones are one, in
    so many copies. (Should two others get one name, they are compared as one block.)
    """
    keys, sets, tags, at, seen = [], [], [], [], 0
    for blob in pdf["packed"]:
        tag, table, key = _unpacked(blob)
        keys.append(key)
        at.append(np.repeat(np.arange(seen, seen + len(table), dtype=np.int32), table["times"]))
        sets.append(table)
        tags.append(tag)
        seen += len(table)
    key, own, table, tag = np.concatenate(keys), np.concatenate(at), np.concatenate(sets), np.concatenate(tags)
    keys, at, sets, tags = [], [], [], []
    order = np.argsort(key)
    same = np.concatenate(([False], key[order[1:]] == key[order[:-1]], [False]))
    order = order[same[1:] | same[:-1]]
    key, table, tag = key[order], table[own[order]], tag[own[order]]
    slot, need = table["slot"], table["need"]
    order = np.lexsort((slot, tag, key))
    key, tag, slot, need = key[order], tag[order], slot[order], need[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1]) | (slot[1:] != slot[:-1])
    key, tag, slot, need = key[new], tag[new], slot[new], need[new]
    name, copies, others = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(key):
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(cuts, len(key)))
        names = np.add.reduceat(mixed(tag ^ mixed(slot.astype(np.uint64), 3), 4), cuts)
        useful = (size > 1) & (np.minimum.reduceat(slot, cuts) < _PROBES)
        _, one, which = np.unique(names, return_index=True, return_inverse=True)
        times = np.bincount(which, useful, len(one)).astype(np.int64)
        keep = np.zeros(len(cuts), bool)
        keep[one] = useful[one]
        rows = np.repeat(keep, size)
        name, copies, others = (np.repeat(x, size)[rows] for x in (names, times[which], size - 1))
        tag, slot, need = tag[rows], slot[rows], need[rows]
    return pd.DataFrame({"block": name.view(np.int64), "tag": tag.view(np.int64), "slot": slot.astype(np.int32), "need": need.astype(np.int64), "copies": copies, "others": others})


def _that_may_link(tagged: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, tag, slot, others) of the sets and blocks that can still show a link.

    A set that shares s blocks and needs n of them with a linked set keeps its
    s - n + 1 smallest ones: the smallest block that two linked sets share has n - 1
    more of theirs behind it in the order of either.
    """
    rows = tagged.groupBy("block", "tag", "slot").agg(F.sum("copies").alias("copies"), F.min("need").alias("need"), F.max("others").alias("others"))
    of_set = Window.partitionBy("tag", "slot")  # a row for each block of one set
    shared, need = F.sum("copies").over(of_set), F.min("need").over(of_set)
    rows = scratch.written(rows.withColumn("enough", shared >= need).where("enough").drop("enough"), "shared")
    rows = _of_several(rows, scratch)
    before = F.coalesce(F.sum("copies").over(of_set.orderBy("others", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = scratch.written(rows.withColumn("early", before < shared - need + 1).where("early").select("block", "tag", "slot", "others"), "early")
    return _of_several(rows, scratch)


def _of_several(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of blocks that still have two members or more, one of them more than a probe."""
    several = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("slot").alias("slot")).where((F.col("n") > 1) & (F.col("slot") < _PROBES)).select("block")
    return rows.join(scratch.written(several, "several"), "block", "left_semi")


def sketch(found: np.ndarray) -> np.ndarray:
    """The dense parity sketch: SKETCH_WORDS words, doubled until there is a bit or more per member."""
    words = SKETCH_WORDS
    while 64 * words < len(found):
        words *= 2
    odd = np.bincount((found & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _emit_sets(bits: int, wanted):
    """Sets and dense sketches of the documents whose slot is in the candidate filter."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("members", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.frombuffer(wanted.value, np.uint8)
        rows, held = [], 0
        for batch in batches:
            batch = batch.filter(pa.array(in_filter(filled, batch.column(2).to_numpy())))
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            for i, found in shingle_sets(batch.column(1)):
                rows.append((ids[i], len(found), found.tobytes(), sketch(found).tobytes()))
                held += 9 * len(found) + 64
                if held > _SETS_AT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _linked(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_are_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True)], dtype=bool)


def _are_linked(one: np.ndarray, two: np.ndarray) -> bool:
    if len(one) > len(two):
        one, two = two, one
    near = np.minimum(np.searchsorted(two, one), max(len(two) - 1, 0))
    both = int((two[near] == one).sum()) if len(two) else 0
    return 100 * both >= 80 * (len(one) + len(two) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose exact sets are linked."""
    same = F.pandas_udf(_linked, "boolean")
    left = sets.select(F.col("node").alias("u"), F.col("members").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("members").alias("b"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").where(same("a", "b")).select("u", "v").distinct()


def _may_link(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether the sketches of two sets allow a similarity of 0.8; ``a`` and ``b`` have columns n and sketch."""
    out = []
    for x, y, most in zip(a["sketch"], b["sketch"], (a["n"] + b["n"]).tolist(), strict=True):
        one, two = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if len(one) != len(two):
            one, two = sorted((one, two), key=len)
            two = two[: len(one)] ^ two[len(one) :]
        out.append(9 * int(np.bitwise_count(one ^ two).sum()) <= most)
    return pd.Series(out, dtype=bool)


class _Tiles:
    """The members of a task's group, sorted by tile, and the pairs to compare.

    Members of side 2 are a whole block and meet each other; those of side 0 meet
    those of side 1. The first of a pair has the smaller set, and is no mere probe.
    """

    def __init__(self, pdf: pd.DataFrame):
        columns = {c: pdf[c].to_numpy() for c in ("block", "i", "j", "side", "node", "n", "label", "probe")}
        order = np.lexsort((columns["side"], columns["j"], columns["i"], columns["block"]))
        self.block, i, j, side, self.node, self.n, self.label, self.probe = (c[order] for c in columns.values())
        self.data = pdf["data"].to_numpy()[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.block[1:] != self.block[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.flatnonzero(new)
        ends, whole = np.append(starts[1:], len(order)), side[starts] == 2
        middle = starts + np.add.reduceat((side == 0).astype(np.int64), starts)
        self.a0, self.a1 = starts, np.where(whole, ends, middle)
        self.b0, self.b1 = np.where(whole, starts, middle), ends

    def pairs(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of the tiles from a to before b, each pair of nodes once."""
        wide = self.b1[a:b] - self.b0[a:b]
        count = (self.a1[a:b] - self.a0[a:b]) * wide
        tile = np.repeat(np.arange(b - a), count)
        local = np.arange(len(tile)) - np.repeat(np.cumsum(count) - count, count)
        x, y = self.a0[a:b][tile] + local // wide[tile], self.b0[a:b][tile] + local % wide[tile]
        n, m = self.n[x], self.n[y]
        fits = (n <= m) & (5 * n >= 4 * m) & ~self.probe[x] & (self.label[x] != self.label[y])
        fits &= (n < m) | self.probe[y] | (self.node[x] < self.node[y])
        x, y = x[fits], y[fits]
        names, code = np.unique(np.concatenate([self.node[x], self.node[y]]), return_inverse=True)
        _, one = np.unique(code[: len(x)] * len(names) + code[len(x) :], return_index=True)
        return x[one], y[one]

    def batches(self, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Runs of whole tiles with about ``most`` pairs."""
        upto = np.concatenate(([0], np.cumsum((self.a1 - self.a0) * (self.b1 - self.b0))))
        a = 0
        while a < len(self.a0):
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + most, side="right")) - 1)
            yield a, b
            a = b


def _near(tiles: _Tiles, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the sketches of the pairs allow a link."""
    out = np.zeros(len(x), bool)
    length = np.array([len(d) for d in tiles.data]) // 8
    at = np.concatenate(([0], np.cumsum(length)))
    words = np.frombuffer(b"".join(tiles.data), np.uint64)

    def folded(rows: np.ndarray, width: int) -> np.ndarray:
        got = words[at[rows][:, None] + np.arange(width)[None, :]]
        twice = np.flatnonzero(length[rows] > width)
        if len(twice):
            got[twice] ^= words[at[rows[twice]][:, None] + np.arange(width, 2 * width)[None, :]]
        return got

    least = np.minimum(length[x], length[y])
    for width in np.unique(least).tolist():
        mine = np.flatnonzero(least == width)
        step = max(1, (1 << 20) // width)
        for k in range(0, len(mine), step):
            p = mine[k : k + step]
            apart = np.bitwise_count(folded(x[p], width) ^ folded(y[p], width)).sum(axis=1, dtype=np.int64)
            out[p] = 9 * apart <= tiles.n[x[p]] + tiles.n[y[p]]
    return out


def _shared_members(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the members that both sides have."""
    out = np.zeros((len(one), len(two)), np.int64)
    a, b = np.concatenate(one), np.concatenate(two)
    common = np.intersect1d(a, b)
    if not len(common):
        return out
    cells = []
    for side, flat in ((one, a), (two, b)):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = common[at] == flat
        cells.append((np.repeat(np.arange(len(side)), [len(x) for x in side])[hit], at[hit]))
    for k in range(0, len(common), 4096):
        grids = []
        for side, (row, col) in zip((one, two), cells, strict=True):
            here = (col >= k) & (col < k + 4096)
            grid = np.zeros((len(side), min(4096, len(common) - k)), np.float32)
            grid[row[here], col[here] - k] = 1
            grids.append(grid)
        out += (grids[0] @ grids[1].T).astype(np.int64)
    return out


def _sketched(pdf: pd.DataFrame) -> pd.DataFrame:
    """(block, node) of the members that may have a link across components, by their sketches."""
    tiles = _Tiles(pdf)
    found = []
    for a, b in tiles.batches():
        x, y = tiles.pairs(a, b)
        near = _near(tiles, x, y)
        x, y = x[near], y[near]
        found.append(pd.DataFrame({"block": np.concatenate([tiles.block[x], tiles.block[x]]), "node": np.concatenate([tiles.node[x], tiles.node[y]])}).drop_duplicates())
    return pd.concat(found, ignore_index=True).drop_duplicates()


def _forest(pdf: pd.DataFrame) -> pd.DataFrame:
    """(u, v): verified links that join the components of a group's members, no more than it takes."""
    tiles, us, vs = _Tiles(pdf), [], []
    members = [np.frombuffer(d, np.uint64) for d in tiles.data]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for a in range(len(tiles.a0)):
        x, y = tiles.pairs(a, a + 1)
        if len(x) > 64:
            rows, row = np.unique(x, return_inverse=True)
            cols, col = np.unique(y, return_inverse=True)
            both = _shared_members([members[i] for i in rows], [members[j] for j in cols])[row, col]
            hit = 100 * both >= 80 * (tiles.n[x] + tiles.n[y] - both)
            x, y = x[hit], y[hit]
            sure = True
        else:
            sure = False
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            one, two = top(int(tiles.label[i])), top(int(tiles.label[j]))
            if one != two and (sure or _are_linked(members[i], members[j])):
                root[one] = two
                us.append(tiles.node[i])
                vs.append(tiles.node[j])
    return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})


def _in_tiles(members: DataFrame, data: DataFrame, weight: Column, run, schema: str, scratch: Scratch) -> DataFrame:
    """``run`` over all tiles of all blocks; ``members`` has block, node, n, label and probe, ``data`` node and data of about ``weight`` bytes.

    A block's members are dealt to chunks of about TILE_ROWS rows and TILE_BYTES
    bytes, and every pair of chunks is a tile. Blocks of one chunk share groups.
    The data joins last, so that it is shuffled once.
    """
    of_block = members.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum(weight) / TILE_BYTES)).cast("int").alias("chunks"), F.sum(weight + 64).alias("bytes"))
    of_block = scratch.written(of_block, "chunks")
    total = of_block.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    groups = 1 + int(total) // GROUP_BYTES
    dealt = members.join(of_block.select("block", "chunks"), "block").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(21)), F.col("chunks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    columns = ["block", "node", "n", "label", "probe"]
    whole = dealt.where("chunks = 1").select(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group"), *columns, F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"))
    large = dealt.where("chunks > 1")
    of_tile = F.xxhash64("block", "i", "j").alias("group")
    one = large.where(~F.col("probe")).select(*columns, F.col("chunk").alias("i"), every.alias("j"), F.lit(0).alias("side"))
    two = large.select(*columns, every.alias("i"), F.col("chunk").alias("j"), F.lit(1).alias("side"))
    parts = one.unionByName(two)
    tiles = scratch.written(whole.unionByName(parts.select(of_tile, *parts.columns)), "tiles")
    return tiles.join(data, "node").groupBy("group").applyInPandas(run, schema)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row for each row of ``docs``.

    ``docs`` needs doc_id (unique) and text; other columns are ignored. A-Z count
    as a-z. Texts of one to four words are one shingle; null and empty texts, or
    texts of white space, have none and stay alone. Texts of any length are read
    whole; sketches and blocks grow with them. Equal sets, and ties in size, are
    linked like all others. Rows that repeat a doc_id with the same text come out
    once each, alike. Rows without doc_id take the component of a row with their
    set of shingles, or none. No rows give no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = scratch.written(rows.mapInArrow(_profile, "doc_id long, t1 long, t2 long, n long"), "profile")
    nodes = scratch.written(profile.where("n > 0").groupBy("t1", "t2", "n").agg(F.min("doc_id").alias("node")), "nodes")
    shingles = int(profile.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    frequent = spark.sparkContext.broadcast(_frequent(rows.select("text"), shingles))
    parts = min(1 << 24, max(int(spark.conf.get("spark.sql.shuffle.partitions")), shingles // PART_SHINGLES))
    packed = rows.select("text").mapInArrow(_emit_blocks(parts, frequent), "part int, packed binary")
    shared = packed.groupBy("part").applyInPandas(_shared_blocks, "block long, tag long, slot int, need long, copies long, others long")
    tagged = scratch.written(shared, "blocks")
    frequent.destroy()
    named_nodes = nodes.where("node is not null").select(F.shiftrightunsigned("t1", 24).alias("tag"), "n", "node")
    met = _that_may_link(tagged, scratch).join(named_nodes, "tag").select("block", "node", "n", (F.col("slot") == _PROBES).alias("probe"), "others")
    met = scratch.written(met, "met")
    scratch.drop("blocks", "shared", *scratch.tables("several"), "early")
    candidates = scratch.written(met.select("node").distinct(), "candidates")
    labels = spark.createDataFrame([], "node long, label long")
    if some := candidates.count():
        bits, filled = filter_of(candidates.select(F.xxhash64("node")), some)
        wanted = spark.sparkContext.broadcast(filled)
        slotted = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(bits)))
        sets = scratch.written(slotted.mapInArrow(_emit_sets(bits, wanted), "node long, n long, members binary, sketch binary"), "sets")
        wanted.destroy()
        labels = _labels(met, sets, scratch)
    named = scratch.written(nodes.join(labels, "node", "left").select("t1", "t2", "n", F.coalesce("label", "node").alias("component_id")), "named")
    scratch.drop(but=("profile", "named"))
    out = profile.join(named, ["t1", "t2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _one_of_alike(members: DataFrame, scratch: Scratch) -> DataFrame:
    """``members`` with blocks of the same members as one, named by these (should two others get one name, they are compared as one block)."""
    rows = members.distinct()
    names = scratch.written(rows.groupBy("block").agg(F.bit_xor(F.xxhash64("node", "probe")).alias("name")), "names")
    return rows.join(names, "block").withColumn("block", F.col("name")).drop("name").distinct()


def _labels(met: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of the components, for nodes with links."""
    sketches = sets.select("node", "n", "sketch")
    # Centre links: in every block all members against the one that meets most others.
    scores = met.groupBy("node").agg(F.sum("others").alias("score"))
    centre = F.max(F.struct(F.col("score"), (-F.col("node")).alias("minus"), F.col("n"))).alias("c")
    centres = scratch.written(met.join(scores, "node").groupBy("block").agg(centre).select("block", (-F.col("c.minus")).alias("u"), F.col("c.n").alias("m")), "centres")
    star = met.join(centres, "block").where("u <> node and 5 * least(n, m) >= 4 * greatest(n, m)").select("u", F.col("node").alias("v")).distinct()
    left = sketches.select(F.col("node").alias("u"), F.struct("n", "sketch").alias("one"))
    right = sketches.select(F.col("node").alias("v"), F.struct("n", "sketch").alias("two"))
    near = F.pandas_udf(_may_link, "boolean")
    tested = star.join(left, "u").join(right, "v").where(near("one", "two")).select("u", "v")
    first = scratch.written(_verified(scratch.written(tested, "star"), sets), "links")
    # All other pairs: only across components, and only where sizes and sketches allow a link.
    labels = components(first, scratch)
    known = scratch.written(met.join(labels, "node", "left").select("block", "node", "n", "probe", F.coalesce("label", "node").alias("label")), "labelled")
    open_blocks = scratch.written(known.groupBy("block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("block"), "open")
    members = scratch.written(_one_of_alike(known.join(open_blocks, "block"), scratch), "members")
    weight = F.greatest(F.lit(64 * SKETCH_WORDS // 8), F.col("n") / 4)
    sketched = _in_tiles(members, sketches.select("node", F.col("sketch").alias("data")), weight, _sketched, "block long, node long", scratch)
    near = scratch.written(sketched, "sketched")
    left_over = scratch.written(_one_of_alike(members.join(near.distinct(), ["block", "node"]), scratch), "left-over")
    more = _in_tiles(left_over, sets.select("node", F.col("members").alias("data")), 8 * F.col("n"), _forest, "u long, v long", scratch)
    more = scratch.written(more.distinct(), "more")
    return components(first.unionByName(more), scratch) if more.count() else labels


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names its component, with their columns as they were.

    Cases are those of ``jaccard_components``: documents without words and rows
    without doc_id all stay, rows that repeat a doc_id stay or go together, and
    columns with other names are carried along. No rows give no rows.
    """
    ids = jaccard_components(docs).groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    return without_rows(docs, ids.where("not stays"))


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(a[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, a, unnest(range(1, greatest(len(a) - 4, 1) + 1)) AS i FROM w WHERE len(a) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

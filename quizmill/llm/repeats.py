"""Operator 1, suffix-array dedup: column-wise construction over many documents.

The Burrows-Wheeler transform of a collection and its common prefixes are built
one column at a time: every round prepends one symbol to the current suffix of
each string, finds the place of the new suffixes by the last-to-first mapping and
rewrites the transform, its suffix owners and the common-prefix marks front to
back with the new entries merged in. See ``collection_order``.

A round costs a pass over all entries, and whole documents would need as many
rounds as the longest has bytes. So the collection is dealt out first, without
losing a repeat: among the 20-byte substrings of every 50-byte string the one
with the smallest hash is its anchor; consecutive 50-byte strings with one
anchor form a run, and equal strings have equal anchors. A run (50 to 113 bytes)
is one string of the collection of its anchor's part, so a construction takes at
most 113 rounds. Anchors that one document alone holds cannot bring repeats; a
filter of fixed maximal size, built from the anchors of all documents in a first
pass, keeps most of them from being shuffled at all (its false hits cost time only).

Anchors with more runs than a collection takes go another way, so that no task
gets all runs of one: see ``common_spans``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import blocks, mixed, table, written

LENGTH = 50
ANCHOR = 20
#: 50-byte strings in one run at most.
RUN = 64
#: Bits of the anchor filter that tasks get: 32 MB at most.
FILTER_BITS_MOST = 1 << 28
#: Runs of one collection at most; equal ones become one string. Anchors with more runs are common ones.
COLLECTION = 12_000
_CHUNK = 1 << 18
_FAR = np.iinfo(np.int64).max


def anchor_runs(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of 50-byte strings, anchor) of the runs of all texts in a block."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, np.zeros(0, np.uint64)
    x = raw.astype(np.uint64)
    for step in (1, 2, 4):  # eight bytes from each place on
        x = x[:-step] | (x[step:] << np.uint64(8 * step))
    end = n - ANCHOR + 1
    h = x[:end] * np.uint64(0x9E3779B97F4A7C15)
    h += x[8 : end + 8] * np.uint64(0xC2B2AE3D27D4EB4F)
    h += x[12 : end + 12] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    for step in (1, 2, 4, 8, LENGTH - ANCHOR + 1 - 16):  # least of 31
        h = np.minimum(h[:-step], h[step:])
    inner = offsets[1:-1]
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, np.maximum(inner - (LENGTH - 1), 0), 1)
    np.add.at(depth, inner, -1)
    whole = np.cumsum(depth)[: n - LENGTH + 1] == 0  # the string lies in one text
    same = (h[1:] == h[:-1]) & whole[1:] & whole[:-1]
    first, last = whole.copy(), whole.copy()
    first[1:] &= ~same
    last[:-1] &= ~same
    starts = np.flatnonzero(first)
    counts = np.flatnonzero(last) + 1 - starts
    if len(counts) and counts.max() > RUN:
        pieces = -(-counts // RUN)
        order = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, left = np.repeat(starts, pieces) + order * RUN, np.repeat(counts, pieces) - order * RUN
        counts = np.minimum(left, RUN)
    return starts, counts, h[starts]


def _part_of(anchor: np.ndarray, parts: int) -> np.ndarray:
    return ((anchor & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int32)


def _cuts(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1], [True])))


def _emit_anchors(parts: int):
    """Per batch and part the distinct anchors, those of one document, then those of several, and their numbers of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, owners = [], []
            for row, _, offsets, raw in blocks(batch.column(0), _CHUNK):
                starts, _, anchor = anchor_runs(offsets, raw)
                anchors.append(anchor)
                owners.append((row + np.searchsorted(offsets, starts, side="right") - 1).astype(np.int32))
            anchor, owner = np.concatenate(anchors or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int32)])
            if not len(anchor):
                continue
            order = np.argsort(anchor)
            anchor, owner = anchor[order], owner[order]
            cuts = _cuts(anchor)
            count = np.minimum(np.diff(cuts), 0xFFFF).astype(np.uint16)
            cuts = cuts[:-1]
            several = np.minimum.reduceat(owner, cuts) != np.maximum.reduceat(owner, cuts)
            anchor = anchor[cuts]
            part = _part_of(anchor, parts)
            order = np.lexsort((several, part))
            anchor, part, several, count = (anchor[order] >> np.uint64(16)), part[order], several[order], count[order]
            at = _cuts(part)
            names, blobs = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                names.append(int(part[a]))
                short = np.ascontiguousarray(anchor[a:b].view(np.uint8).reshape(-1, 8)[:, :6])
                blobs.append(np.array([b - a, several[a:b].sum()], np.uint32).tobytes() + short.tobytes() + count[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "packed"])

    return run


def _shared_anchors(most_bits: int, most: int):
    """A part's anchor filter, and its anchors with more than ``most`` runs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one, more = [], []
        for blob in pdf["packed"]:
            n, several = (int(v) for v in np.frombuffer(blob, np.uint32, 2))
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, 8).reshape(-1, 6)
            anchor = wide.view(np.uint64).ravel()
            one.append(anchor << np.uint64(16) | np.frombuffer(blob, np.uint16, n, 8 + 6 * n))
            more.append(anchor[n - several :])
        counted = np.sort(np.concatenate(one))
        seen = counted >> np.uint64(16)
        cuts = _cuts(seen)[:-1]
        common = seen[cuts][np.add.reduceat((counted & np.uint64(0xFFFF)).astype(np.int64), cuts) > most]
        shared = np.unique(np.concatenate([seen[1:][seen[1:] == seen[:-1]], *more]))
        common = common[np.isin(common, shared)]
        bits = 64
        while bits < min(16 * len(shared), most_bits):
            bits *= 2
        flags = np.zeros(bits, np.uint8)
        flags[(mixed(shared) & np.uint64(bits - 1)).astype(np.int64)] = 1
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "bits": [bits], "filled": [np.packbits(flags, bitorder="little").tobytes()], "common": [common.tobytes()]})

    return run


class AnchorFilter:
    """One small bit set per part, and the common anchors, which belong to no part."""

    def __init__(self, parts: int, rows: list[tuple[int, int, bytes]], common: np.ndarray):
        self.parts, self.common = parts, np.unique(common)
        self.mask, self.start, pieces, at = np.zeros(parts, np.uint64), np.zeros(parts, np.int64), [bytes(8)], 64
        for part, bits, filled in rows:
            self.mask[part], self.start[part] = bits - 1, at
            pieces.append(filled)
            at += bits
        self.filled = np.frombuffer(b"".join(pieces), np.uint8)

    def of(self, anchor: np.ndarray, part: np.ndarray) -> np.ndarray:
        at = self.start[part] + (mixed(anchor >> np.uint64(16)) & self.mask[part]).astype(np.int64)
        return ((self.filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1) & ~self.is_common(anchor)

    def is_common(self, anchor: np.ndarray) -> np.ndarray:
        if not len(self.common):
            return np.zeros(len(anchor), bool)
        short = anchor >> np.uint64(16)
        return self.common[np.minimum(np.searchsorted(self.common, short), len(self.common) - 1)] == short


_ENTRY = np.dtype([("doc", "<i8"), ("anchor", "<u8"), ("pos", "<i4"), ("count", "u1")])


def _gather(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.uint8)
    return raw[np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


def _emit_runs(parts: int, wanted):
    """Per batch and part the runs whose anchor may be shared, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            entries, texts = [], []
            for row, _, offsets, raw in blocks(batch.column(1), _CHUNK):
                starts, counts, anchor = anchor_runs(offsets, raw)
                hit = keep.of(anchor, _part_of(anchor, parts))
                starts, counts, anchor = starts[hit], counts[hit], anchor[hit]
                own = np.searchsorted(offsets, starts, side="right") - 1
                e = np.zeros(len(starts), _ENTRY)
                e["doc"], e["anchor"], e["pos"], e["count"] = ids[row + own], anchor, starts - offsets[own], counts
                entries.append(e)
                texts.append(_gather(raw, starts, counts + LENGTH - 1))
            if not entries:
                continue
            e, text = np.concatenate(entries), np.concatenate(texts)
            size = e["count"].astype(np.int64) + LENGTH - 1
            begin = np.cumsum(size) - size
            part = _part_of(e["anchor"], parts)
            order = np.lexsort((e["anchor"], part))
            e, part, size, begin = e[order], part[order], size[order], begin[order]
            at = _cuts(part)
            names, blobs = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                names.append(int(part[a]))
                columns = b"".join(np.ascontiguousarray(e[n][a:b]).tobytes() for n in _ENTRY.names)
                blobs.append(np.array([b - a], np.int64).tobytes() + packer.compress(columns + _gather(text, begin[a:b], size[a:b]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "packed"])

    return run


def _emit_common(wanted):
    """(run, doc, pos): the runs of common anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, _, offsets, raw in blocks(batch.column(1), _CHUNK):
                starts, counts, anchor = anchor_runs(offsets, raw)
                hit = keep.is_common(anchor)
                starts, size = starts[hit], counts[hit] + LENGTH - 1
                own = np.searchsorted(offsets, starts, side="right") - 1
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
                texts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(_gather(raw, starts, size).tobytes())])
                columns = [texts.cast(pa.binary()), pa.array(ids[row + own], pa.int64()), pa.array(starts - offsets[own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["run", "doc", "pos"])

    return run


def collection_order(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common) of a collection's suffixes of LENGTH bytes or more, in lexical order.

    ``symbols`` holds a string per row, its bytes plus one, padded with zeros on
    the right. ``common`` marks suffixes whose first LENGTH bytes equal those of
    the entry before. Round j inserts the suffixes of length j: the transform's
    next symbols are filled in, the last-to-first mapping gives the places of the
    longer suffixes, and the transform is rewritten with room for them. Owners and
    common prefixes are kept for suffixes that are long enough to matter.
    """
    m, width = symbols.shape
    flat = np.zeros((m, width + 8), np.uint8)
    flat[:, :width] = symbols
    words = flat.ravel().astype(np.uint64)
    for step in (1, 2, 4):
        words = words[:-step] | (words[step:] << np.uint64(8 * step))
    probes = [*range(0, LENGTH - 7, 8), LENGTH - 8]

    transform = np.zeros(m, np.uint8)  # zero: the end of a string, or a symbol of this round
    live, place = np.arange(m), np.arange(m)  # strings in order of their newest suffixes, and where those are
    long = np.zeros(m, bool)
    owner, size, common = np.zeros(0, np.int32), np.zeros(0, np.int16), np.zeros(0, bool)
    for j in range(1, int(lengths.max(initial=0)) + 1):
        on = lengths[live] >= j
        live, place = live[on], place[on]
        symbol = symbols[live, lengths[live] - j]
        transform[place] = symbol
        fresh = np.zeros(len(transform), bool)
        fresh[place] = True
        mapped = np.argsort(transform, kind="stable")[np.count_nonzero(transform == 0) :]
        place = m + np.flatnonzero(fresh[mapped])
        live = live[np.argsort(symbol, kind="stable")]
        old = np.ones(m + len(mapped), bool)
        old[place] = False
        transform = _with_room(transform, old)
        if j < LENGTH:
            continue
        long = _with_room(long, old) if j > LENGTH else np.zeros(len(old), bool)
        spots = np.cumsum(long)[place] + np.arange(len(place))
        long[place] = True
        old = np.ones(len(owner) + len(spots), bool)
        old[spots] = False
        owner, size, common = (_with_room(column, old) for column in (owner, size, common))
        owner[spots], size[spots] = live, j
        near = np.unique(np.concatenate([spots, spots + 1]))
        near = near[(near > 0) & (near < len(owner))]
        a, b = (owner[x].astype(np.int64) * (width + 8) + lengths[owner[x]] - size[x] for x in (near - 1, near))
        same = np.ones(len(near), bool)
        for k in probes:
            same &= words[a + k] == words[b + k]
        common[near] = same
    return owner, size, common


def _with_room(column: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The column rewritten front to back, zeros where ``old`` is false."""
    wider = np.zeros(len(old), column.dtype)
    wider[old] = column
    return wider


def _first_documents(symbols: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each string and place the smallest document that holds the 50 bytes from there on."""
    owner, size, common = collection_order(symbols, lengths)
    first = np.full((len(lengths), RUN), _FAR)
    if len(owner):
        heads = np.flatnonzero(~common)
        smallest = np.minimum.reduceat(least[owner], heads)
        first[owner, lengths[owner] - size] = np.repeat(smallest, np.diff(np.append(heads, len(owner))))
    return first


def _repeats_of(e: np.ndarray, text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the repeated bytes among runs of one collection."""
    length = e["count"].astype(np.int64) + LENGTH - 1
    grid = np.zeros((len(e), RUN + LENGTH - 1), np.uint8)
    rows = np.repeat(np.arange(len(e)), length)
    grid[rows, np.arange(len(rows)) - np.repeat(np.cumsum(length) - length, length)] = _gather(text, begin, length) + np.uint8(1)
    # Equal strings become one; a hash finds them and the bytes confirm them.
    weights = mixed(np.arange(grid.shape[1], dtype=np.uint64), 3) | np.uint64(1)
    code = np.zeros(len(e), np.uint64)
    for a in range(0, len(e), 4096):
        code[a : a + 4096] = (mixed(grid[a : a + 4096].astype(np.uint64), 4) * weights).sum(axis=1, dtype=np.uint64)
    _, index, which = np.unique(code, return_index=True, return_inverse=True)
    differs = np.flatnonzero((grid != grid[index[which]]).any(axis=1))
    which[differs] = len(index) + np.arange(len(differs))
    index = np.concatenate([index, differs])
    least = np.full(len(index), _FAR)
    np.minimum.at(least, which, e["doc"])
    # A string that is alone with its anchor meets no other; its places have its own smallest document.
    _, group, members = np.unique(e["anchor"][index], return_inverse=True, return_counts=True)
    met = np.flatnonzero(members[group] > 1)
    first = np.repeat(least[:, None], RUN, axis=1)
    first[np.arange(RUN)[None, :] >= e["count"][index][:, None]] = _FAR
    first[met] = _first_documents(grid[index[met]], length[index[met]], least[met])
    docs, starts, ends = [], [], []
    for a in range(0, len(e), 8192):
        part = e[a : a + 8192]
        gone = np.zeros((len(part), RUN + 2), np.int8)
        gone[:, 1:-1] = first[which[a : a + 8192]] < part["doc"][:, None]
        step = np.diff(gone, axis=1)
        row, col = np.nonzero(step == 1)
        _, stop = np.nonzero(step == -1)
        docs.append(part["doc"][row])
        starts.append(part["pos"][row] + col)
        ends.append(part["pos"][row] + stop - 1 + LENGTH)
    return np.concatenate(docs), np.concatenate(starts), np.concatenate(ends)


def _repeats_in_part(parts: int):
    return lambda pdf: _found_in_part(pdf, parts)


def _found_in_part(pdf: pd.DataFrame, parts: int) -> pd.DataFrame:
    """(bucket, packed): the repeats among one part's runs as (doc, start, end), dealt out by document."""
    entries, texts = [], []
    reader = zstandard.ZstdDecompressor()
    for blob in pdf["packed"]:
        n, data, at = int(np.frombuffer(blob, np.int64, 1)[0]), reader.decompress(bytes(blob)[8:]), 0
        e = np.zeros(n, _ENTRY)
        for name in _ENTRY.names:
            e[name] = np.frombuffer(data, _ENTRY[name], n, at)
            at += n * _ENTRY[name].itemsize
        entries.append(e)
        texts.append(np.frombuffer(data, np.uint8, -1, at))
    e, text = np.concatenate(entries), np.concatenate(texts)
    size = e["count"].astype(np.int64) + LENGTH - 1
    begin = np.cumsum(size) - size
    order = np.argsort(e["anchor"], kind="stable")
    e, begin = e[order], begin[order]
    cuts = _cuts(e["anchor"])
    if len(e):
        several = np.minimum.reduceat(e["doc"], cuts[:-1]) != np.maximum.reduceat(e["doc"], cuts[:-1])
        keep = np.repeat(several, np.diff(cuts))
        e, begin = e[keep], begin[keep]
        cuts = _cuts(e["anchor"])
    found, a = [], 0
    while a < len(cuts) - 1:
        b = max(int(np.searchsorted(cuts, cuts[a] + COLLECTION, side="right")) - 1, a + 1)
        found.append(_repeats_of(e[cuts[a] : cuts[b]], text, begin[cuts[a] : cuts[b]]))
        a = b
    none = np.zeros(0, np.int64)
    doc, start, end = (np.concatenate(x) for x in zip((none, none, none), *found, strict=True))
    bucket, packed = _dealt(doc, start, end, parts)
    return pd.DataFrame({"bucket": bucket, "packed": packed})


def _dealt(doc: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """Buckets and their packed triples, dealt out by document."""
    bucket = (mixed(doc.view(np.uint64), 9) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((start, doc, bucket))
    bucket, triples = bucket[order], np.stack([doc, start, end], axis=1)[order]
    at = _cuts(bucket)
    return bucket[at[:-1]], [triples[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]


def _dealt_spans(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, packed = _dealt(*(c.to_numpy(zero_copy_only=False) for c in batch.columns), parts)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    return run


def _met(rows: DataFrame, few: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` joined with ``few``, which has a key once and the number n of its rows; keys with more than ``most`` rows are broadcast, so none fills a task."""
    heavy = few.where(F.col("n") > most)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(few.where(F.col("n") <= most), key))


def common_spans(runs: DataFrame, most: int) -> DataFrame:
    """(doc, start, end): the repeats among the runs of common anchors, with map-side aggregates and joins.

    Equal runs become one text with its smallest document: in every other document
    the whole run is a repeat. In the smallest one a 50-byte string is a repeat if
    another text that holds it has a smaller document.
    """
    runs = written(runs, "common-runs")
    texts = runs.groupBy("run").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "common-texts")
    pieces = F.transform(F.sequence(F.lit(1), F.octet_length("run") - (LENGTH - 1)), lambda i: F.substring(F.col("run"), i, F.lit(LENGTH)))
    strings = texts.select("id", "least", F.posexplode(pieces).alias("at", "string"))
    firsts = strings.groupBy("string").agg(F.min("least").alias("first"), F.max("least").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    earlier = _met(strings, written(firsts, "common-firsts"), "string", most).where("first < least").select("id", "at")
    found = _met(runs, texts, "run", most)
    whole = found.where("doc > least").select("doc", F.col("pos").alias("start"), (F.col("pos") + F.octet_length("run")).alias("end"))
    own = found.where("doc = least").select("id", "doc", "pos").join(earlier, "id").select("doc", (F.col("pos") + F.col("at")).alias("start"), (F.col("pos") + F.col("at") + LENGTH).alias("end"))
    return whole.unionByName(own)


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, packed): each document's intervals, overlapping ones joined, as pairs of 32-bit numbers."""
    triples = np.concatenate([np.frombuffer(blob, np.int64).reshape(-1, 3) for blob in pdf["packed"]])
    doc, start, end = triples[np.lexsort((triples[:, 1], triples[:, 0]))].T
    cuts = _cuts(doc)
    names, blobs = doc[cuts[:-1]], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        upto = np.maximum.accumulate(end[a:b])
        heads = np.flatnonzero(np.concatenate(([True], start[a + 1 : b] > upto[:-1])))
        pairs = np.stack([start[a:b][heads], upto[np.append(heads[1:], b - a) - 1]], axis=1)
        blobs.append(pairs.astype(np.int32).tobytes())
    return pd.DataFrame({"doc_id": names, "packed": blobs})


def repeated_spans(docs: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, packed): the repeated byte intervals of each document that has any, as pairs of 32-bit numbers.

    Anchors with more than ``most`` runs (COLLECTION) are common ones.
    """
    most = COLLECTION if most is None else most
    spark = docs.sparkSession
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = rows.select("text").mapInArrow(_emit_anchors(parts), "part int, packed binary")
    shared = anchors.groupBy("part").applyInPandas(_shared_anchors(max(64, FILTER_BITS_MOST // parts), most), "part int, bits long, filled binary, common binary")
    taken = shared.collect()  # at most FILTER_BITS_MOST bits, or 64 a part; and eight bytes for every common anchor
    pieces = [(r["part"], r["bits"], bytes(r["filled"])) for r in taken]
    common = np.frombuffer(b"".join(bytes(r["common"]) for r in taken), np.uint64)
    wanted = spark.sparkContext.broadcast(AnchorFilter(parts, pieces, common))
    runs = rows.mapInArrow(_emit_runs(parts, wanted), "part int, packed binary")
    found = runs.groupBy("part").applyInPandas(_repeats_in_part(parts), "bucket int, packed binary")
    if len(common):
        spans = common_spans(rows.mapInArrow(_emit_common(wanted), "run binary, doc long, pos long"), most)
        found = found.unionByName(spans.mapInArrow(_dealt_spans(parts), "bucket int, packed binary"))
    return found.groupBy("bucket").applyInPandas(_merged, "doc_id long, packed binary")


_CLEANED = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, spans, kept = [], [], []
        for text, packed in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = text or b""
            sizes.append(len(data))
            pairs = np.frombuffer(packed or b"", np.int32).reshape(-1, 2)
            spans.append([{"start": a, "end": b} for a, b in pairs.tolist()])
            if not len(pairs):
                kept.append(data)
                continue
            edges = [0, *pairs.ravel().tolist(), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (start, end in bytes), kept (the bytes left), one row for each row of ``docs``.

    A byte goes if a 50-byte string that covers it also starts in a document with
    a smaller doc_id. ``docs`` needs doc_id (unique) and text; other columns are
    ignored. Null texts count as empty; texts under 50 bytes keep everything.
    Rows that repeat a doc_id with the same text are one document and come out
    once each, alike. Rows without doc_id keep everything and take nothing from
    others. No rows give no rows.
    """
    pieces = written(repeated_spans(docs), "repeat-spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(pieces, "doc_id", "left").mapInArrow(_clean, _CLEANED)


def query(spark, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM t WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
o AS (SELECT w.doc_id, w.i, lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS prev FROM w JOIN m USING (s) WHERE m.first_id < w.doc_id),
k AS (SELECT doc_id, i, sum((prev IS NULL OR i - prev > 50)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
p AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, span),
c AS (SELECT p.doc_id, p.span, p.a, p.b, substr(t.h, 2 * coalesce(lag(p.b) OVER (PARTITION BY p.doc_id ORDER BY p.span), 0) + 1, 2 * (p.a - coalesce(lag(p.b) OVER (PARTITION BY p.doc_id ORDER BY p.span), 0))) AS piece FROM p JOIN t USING (doc_id)),
g AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY span) AS head, max(b) AS last FROM c GROUP BY doc_id)
SELECT t.doc_id, t.n AS n_bytes, coalesce(g.n_removed, 0) AS n_removed, coalesce(g.n_spans, 0) AS n_spans,
  sha256(CASE WHEN g.doc_id IS NULL THEN unhex(t.h) ELSE unhex(coalesce(g.head, '') || substr(t.h, 2 * g.last + 1)) END) AS kept_sha256
FROM t LEFT JOIN g USING (doc_id)
"""

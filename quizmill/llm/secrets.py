"""Operator 5, secret scans: multipart credential linking.

One pass over the texts reports the base kinds (assign, access, hex) and, in
texts that hold any cue, the parts of credentials: access identifiers, secrets
and endpoints, each with its interval and its scope (paragraph). Weak parts are
too common to report by themselves; an interval join within scopes reports them
only when complementary parts lie within SCOPE_POINTS code points:

* weak_id, a user or client identifier: next to a secret, strong or weak;
* weak_secret, a mixed-class run of 20 or more: next to an identifier;
* endpoint, a URL or host setting: next to both an identifier and a secret.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import blocks, table, written

SCOPE_POINTS = 200

# Kinds in the order of the contract, then the linked ones.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WEAK_ID = re.compile(r"""(?:user(?:_?name|_?id)?|login|client_?id|access_?key(?:_?id)?|account_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII | re.IGNORECASE)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ADDRESS = re.compile(r"""[A-Za-z0-9][^\s"'<>]*""", re.ASCII)
HOST = re.compile(r"""(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:-]+""", re.ASCII)
CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"akia", b"user", b"login", b"client", b"access", b"account")

SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+")

ID, SECRET, PLACE = 0, 1, 2
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def _rows_to_read(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Rows that may hold a match: with a cue, or with eight hex digits in a row at every fourth byte."""
    hit = np.zeros(len(offsets) - 1, bool)
    h = _IS_HEX[raw[::4]]
    for step in (1, 2, 4):
        h = h[:-step] & h[step:] if len(h) > step else h[:0]
    found = [np.flatnonzero(h) * 4 + 16]
    low = raw.tobytes().lower()
    for cue in CUES:
        at, places = low.find(cue), []
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            places.append(at)
            at = low.find(cue, int(offsets[row + 1]))
        found.append(np.array(places, np.int64))
    at = np.concatenate(found)
    hit[np.searchsorted(offsets, at, side="right") - 1] = True
    return hit


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in code points, ordered."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def parts(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(role, kind, start, end, scope) of all credential parts; base kinds are strong parts."""
    found = [(ID if kind == 1 else SECRET, kind, a, b) for a, kind, b in base]
    found += [(ID, 3, m.start(1), m.end(1)) for m in WEAK_ID.finditer(text)]
    if not any(role == ID for role, *_ in found):
        return []  # nothing to link secrets or places with
    taken = sorted((a, b) for _, _, a, b in found)
    starts, upto = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for m in WEAK_SECRET.finditer(text):
        s, before = m[0], bisect_left(starts, m.end())
        if before and upto[before - 1] > m.start():
            continue
        if re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search("[0-9]", s):
            found.append((SECRET, 4, m.start(), m.end()))
    found += [(PLACE, 5, a, b) for a, b in endpoints(text)]
    if len({role for role, *_ in found}) < 2:
        return []
    gaps = [m.start() for m in re.finditer(r"\n\x20*\n", text)]
    return [(role, kind, a, b, bisect_right(gaps, a)) for role, kind, a, b in found]


def endpoints(text: str) -> list[tuple[int, int]]:
    """(start, end) of URLs and host settings, leftmost first, without overlaps.

    A scheme is a letter and what follows of SCHEME before "://"; every such run is
    read once, backwards from its "://", and so is the text in between.
    """
    out, pos, host = [], 0, HOST.search(text)
    url = _next_url(text, 0, 0)
    while url or host:
        span = host.span() if host and (not url or host.start() < url[0]) else url[:2]
        out.append(span)
        pos = span[1]
        if url and url[0] < pos:
            url = _next_url(text, pos, max(pos, url[2]))
        if host and host.start() < pos:
            host = HOST.search(text, pos)
    return out


def _next_url(text: str, pos: int, at: int) -> tuple[int, int, int] | None:
    """(start, end, place of "://") of the first URL from ``pos`` on whose "://" is not before ``at``."""
    while (at := text.find("://", at)) >= 0:
        first = at
        while first > pos and text[first - 1] in SCHEME:
            first -= 1
        while first < at and not text[first].islower():
            first += 1
        if first < at and (rest := ADDRESS.match(text, at + 3)):
            return first, rest.end(), at
        at += 3
    return None


SCANNED = "doc_id long, text_key long, n_assign long, n_access long, n_hex long, spans array<struct<start:int,kind:int,end:int>>, parts array<struct<role:int,kind:int,start:int,end:int,scope:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_PART = pa.list_(pa.struct([(n, pa.int32()) for n in ("role", "kind", "start", "end", "scope")]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.num_rows
        counts, spans, found = np.zeros((3, rows), np.int64), [[] for _ in range(rows)], [[] for _ in range(rows)]
        for first, _, offsets, raw in blocks(batch.column(1)):
            for i in np.flatnonzero(_rows_to_read(offsets, raw)):
                text = raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                base = base_spans(text)
                for _, kind, _ in base:
                    counts[kind, first + i] += 1
                spans[first + i] = [{"start": a, "kind": k, "end": b} for a, k, b in base]
                found[first + i] = [dict(zip(("role", "kind", "start", "end", "scope"), x, strict=True)) for x in parts(text, base)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *(pa.array(c) for c in counts), pa.array(spans, _SPAN), pa.array(found, _PART)],
            names=["doc_id", "text_key", "n_assign", "n_access", "n_hex", "spans", "parts"],
        )


def linked(scanned: DataFrame, reach: int = SCOPE_POINTS) -> DataFrame:
    """(doc_id, text_key, more): the weak parts that complementary parts confirm."""
    part = scanned.where(F.size("parts") > 1).dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", F.explode("parts").alias("p"))
    part = part.select("doc_id", "text_key", "p.*")
    cell = lambda c: F.floor(c / reach)
    weak = part.where("kind > 2").withColumn("cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    other = part.select("doc_id", "text_key", "scope", F.col("role").alias("o_role"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    other = other.withColumn("cell", F.explode(F.sequence(cell(F.col("o_start") - reach), cell(F.col("o_end") + reach))))
    keys = [weak[k].eqNullSafe(other[k]) for k in ("doc_id", "text_key", "scope", "cell")]
    near = (weak["role"] != other["o_role"]) & (weak["start"] - other["o_end"] <= reach) & (other["o_start"] - weak["end"] <= reach)
    met = weak.join(other, [*keys, near]).select(weak["doc_id"], weak["text_key"], weak["role"], weak["kind"], weak["start"], weak["end"], "o_role")
    of = met.groupBy("doc_id", "text_key", "role", "kind", "start", "end").agg(
        F.bool_or(F.col("o_role") == ID).alias("an_id"), F.bool_or(F.col("o_role") == SECRET).alias("a_secret")
    )
    sure = of.where(((F.col("role") == ID) & F.col("a_secret")) | ((F.col("role") == SECRET) & F.col("an_id")) | ((F.col("role") == PLACE) & F.col("an_id") & F.col("a_secret")))
    return sure.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, spans: array of (start, kind, end), kind indexing KINDS; one row for each row.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty
    texts have no spans. Texts of any length are read whole, in time that grows with
    their length whatever they hold. Repeated
    rows, and rows without doc_id, are reported alike if their texts are. Spans
    are ordered by start, then kind; those of two kinds may overlap. No rows give
    no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    scanned = written(keyed.mapInArrow(_scan, SCANNED), "secret-parts")
    more = linked(scanned).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "more")
    both = scanned.join(more, scanned["doc_id"].eqNullSafe(more["_id"]) & (scanned["text_key"] == more["_key"]), "left")
    spans = F.array_sort(F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")))
    return both.select("doc_id", "n_assign", "n_access", "n_hex", spans.alias("spans"))


def joined(spans: str, kinds: tuple[str, ...]):
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = found.withColumn("base", F.filter("spans", lambda s: s["kind"] < 3))
    return base.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base", KINDS), 256).alias("base_sha256"), joined("spans", KINDS).alias("spans"))

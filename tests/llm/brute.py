"""Plain Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text: str | None) -> set:
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return set()
    if len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_components(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id)."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by: dict = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    done = set()
    for ids in by.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) in done:
                    continue
                done.add((a, b))
                inter = len(sets[a] & sets[b])
                if 100 * inter >= 80 * (len(sets[a]) + len(sets[b]) - inter):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(docs: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    raw = {i: (t or "").encode() for i, t in docs}
    first: dict[bytes, int] = {}
    for i in sorted(raw):
        for k in range(len(raw[i]) - length + 1):
            first.setdefault(raw[i][k : k + length], i)
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def exact_groups(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """doc_id -> (keep_id, group_size, sha256)."""
    groups: dict[str, list] = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        for _, i in members:
            out[i] = (min(members)[1], len(members), hashlib.sha256(norm.encode()).hexdigest())
    return out

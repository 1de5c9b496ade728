"""Operator 10, PII: anchor expansion.

An Aho-Corasick automaton finds at-signs, scheme separators, identifier cues,
digits and plus signs in every text. From each anchor a deterministic local parser
expands to the boundaries of an email, an address with a login, an account number,
an ip or card number (from a digit) or a phone number (from a plus sign), and
validates it. A kind's parser starts no earlier than its last span ended, and so
finds what a search from left to right finds.

Base kinds: email, ip, card, phone. Added kinds: login (scheme://user:word@host)
and account (an IBAN that passes mod 97, or 8 to 17 digits behind an account cue).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import table
from quizmill.llm.secrets import joined

# Kinds in the order of the contract, then the added ones; anchors and character classes.
KINDS = ("email", "ip", "card", "phone", "login", "account")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"://([A-Za-z0-9._~%+-]+):([^\s/@:\"'<>]+)@([A-Za-z0-9.-]+)")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Z0-9])")
IBAN_HEAD = re.compile(r"(?=[A-Z]{2}[0-9]{2})")
GROUP_END = re.compile(r"(?=\x20|\Z)")
IBAN_LENGTHS = {
    c: int(x[:2]) for x in (
        "15NO 16BE 18DKFIFOGLNL 19MKSI 20ATBAEEKZLTLUXK 21CHHRLILV 22BGBHCRDEGBGEIEMERSVA 23AEGIILIQ 24ADCZESMDPKROSASESKTNVG 25PTST "
        "26ISTR 27FRGRITMCMRSM 28ALAZBYCYDOGTHULBPLSV 29BREGPSQAUA 30JOKWMU 31MTSC 32LC"
    ).split() for c in re.findall("[A-Z]{2}", x)
}
ACCOUNT = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|#))?\x20*[:=#]?\x20*([0-9](?:[\x20-]?[0-9]){7,16})(?![0-9])")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
SCHEME = LETTERS | frozenset("0123456789+.-")

AT, PLACE, CUE, DIGIT, PLUS = range(5)


def automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    auto.add_word("@", (AT, 1))
    auto.add_word("://", (PLACE, 3))
    auto.add_word("+", (PLUS, 1))
    for digit in "0123456789":
        auto.add_word(digit, (DIGIT, 1))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            auto.add_word(form, (CUE, len(form)))
    auto.make_automaton()
    return auto


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Boundaries of the email around the at-sign; it may start at ``floor`` at the earliest."""
    domain = DOMAIN.match(text, at)
    if not domain:
        return None
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    return (start, domain.end()) if start < at else None


def _login(text: str, at: int) -> tuple[int, int] | None:
    """Boundaries of an address with a login around the scheme separator; a scheme starts with a letter."""
    m = LOGIN.match(text, at)
    if not m:
        return None
    start = at
    while start and text[start - 1] in SCHEME:
        start -= 1
    while start < at and text[start] not in LETTERS:
        start += 1
    return (start, m.end()) if start < at else None


def _is_ip(found: str) -> bool:
    parts = [p.lstrip("0") for p in found.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _is_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _iban_end(text: str) -> int | None:
    """Where the IBAN that ``text`` begins with ends: behind a group, at its country's length if that passes mod 97, else the longest that does."""
    ends, usual = [], IBAN_LENGTHS.get(text[:2])
    for m in GROUP_END.finditer(text):
        plain = text[: m.start()].replace(" ", "")
        if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            ends.append((len(plain) == usual, m.start()))
    return max(ends)[1] if ends else None


def _account(text: str, after: int) -> tuple[int, int] | None:
    """An account number behind a cue: a valid IBAN within 20 code points, else 8 to 17 digits."""
    for head in IBAN_HEAD.finditer(text, after, after + 24):
        if m := IBAN.match(text, head.start()):
            if end := _iban_end(m[0]):
                return m.start(), m.start() + end
    m = ACCOUNT.match(text, after)
    return m.span(1) if m else None


def find(text: str, auto: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, ordered."""
    out, numbers = [], set()
    email = ip = card = phone = 0  # where a kind's parser may start next
    for end, (kind, length) in auto.iter(text):
        start = end + 1 - length
        if kind == DIGIT:
            if start >= ip:
                if m := IP.match(text, start):
                    if _is_ip(m[0]):
                        out.append((1, start, m.end()))
                    ip = m.end()
                else:
                    ip = DIGITS.match(text, start).end()  # no other digit of this number does better
            if start >= card:
                m = CARD.match(text, start)
                if m and _is_card(m[0]):
                    out.append((2, start, m.end()))
                card = m.end() if m else end + 1
        elif kind == AT:
            if span := _email(text, start, email):
                out.append((0, *span))
                email = span[1]
        elif kind == PLUS:
            if start >= phone and (m := PHONE.match(text, start)):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((3, start, m.end()))
                phone = m.end()
        elif kind == PLACE:
            if span := _login(text, start):
                out.append((4, *span))
        elif span := _account(text, end + 1):
            numbers.add((5, *span))
    return sorted([*out, *numbers])


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto = automaton()
    for batch in batches:
        spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t, auto)] if (t := x.as_py()) else [] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN)], names=["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end), kind indexing KINDS; one row for each row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty
    texts have no spans. Texts of any length are read whole. Repeated rows, and
    rows without doc_id, are reported alike if their texts are. Spans are ordered
    by kind, then start, in code points, the end exclusive; those of one base kind
    never overlap, and of two accounts with one place one counts. No rows give no
    rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, "doc_id long, spans array<struct<kind:int,start:int,end:int>>")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["kind"] < 4))

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")  # a second parameter would be the index

    counts = [count(kind) for kind in range(4)]
    return found.select("doc_id", *counts, F.sha2(joined("base", KINDS), 256).alias("base_sha256"), joined("spans", KINDS).alias("spans"))

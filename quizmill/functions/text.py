"""Text functions; white space is Unicode white space, as on the platform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\uFEFF]"


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(c, rf"(?U){_SPACE}+", " ")


def strip_quotes(c: Column) -> Column:
    return F.regexp_replace(c, r"""^['"]+""", "")


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def line_number(c: Column, position: Column) -> Column:
    """Newlines before the 0-based position."""
    head = F.substr(c, F.lit(1), position)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def letter_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z]"))


def safe_name(c: Column) -> Column:
    """Characters that object keys may not hold become underscores."""
    return F.regexp_replace(c, "[^a-zA-Z0-9._-]", "_")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]*)$", 1)


def extension(c: Column) -> Column:
    """With its dot; empty without one."""
    return F.regexp_extract(base_name(c), r"(\.[^.]*)$", 1)


def dashes_to_spaces(c: Column) -> Column:
    return F.regexp_replace(c, "-+", " ")


def is_word(c: Column) -> Column:
    return c.rlike("^[A-Za-z][A-Za-z'-]{0,24}$")


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^A-Za-z]+|[^A-Za-z]+$", "")


def or_default(c: Column, default: Column) -> Column:
    """The default where the text is null or blank."""
    return F.coalesce(F.when(trim(c) != "", c), default)


def padded(options: Column, n: int) -> Column:
    """Exactly n entries: cut, or filled with dashes."""
    return F.slice(F.concat(options, F.array_repeat(F.lit("-"), n)), 1, n)


def letter(index: Column) -> Column:
    """0 is A."""
    return F.chr(index + 65)


def is_answer_key_line(c: Column) -> Column:
    return trim(c).rlike(r"(?i)^\d{1,3}\s*(?:[.):]\s*[A-D]|\([A-D]\))$")


def is_garbled(c: Column) -> Column:
    """Text that a broken font or encoding has mangled."""
    s = trim(F.coalesce(c, F.lit("")))
    letters = letter_count(s)
    # Words that a text layer splits, and characters that clean text never holds.
    broken = r"(?i)\b(?:w\s+ill|w\s+ould|w\s+as|w\s+ere|c\s+an|c\s+ould|s\s+hould|t\s+he|t\s+hey|t\s+hat|f\s+or|b\s+e)\b"
    found = ((F.length(s) >= 3) & (letters == 0)) | s.rlike(r"[~^_=<>{}\\|¬`]") | (s.rlike(r"[^A-Za-z0-9\s]{2}") & (letters < F.length(s) * 0.6)) | s.rlike(broken)
    return ~s.isin("", "-") & found

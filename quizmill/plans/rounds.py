"""Model answers that come in pieces: rounds over unfinished rows, cut-off JSON, and what is taken from the raw data instead."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.plans.scratch import written

#: Rounds of a continued answer, and characters of it that a question repeats.
ROUNDS, REPEATED = 5, 100_000


def is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def whole_elements(text: str) -> str | None:
    """Cut-off JSON as JSON of what is whole in it; null if nothing is.

    An element of an array counts once it has ended, at any depth; so does a member of
    the objects around the first array. What is open behind the last such place is
    left out, and all brackets around it are closed.
    """
    if is_json(text):
        return text
    stack: list[str] = []  # closing brackets
    keys: list[bool] = []  # whether a container's next string is a key
    safe, at, n = None, 0, len(text)

    def ended(end: int) -> None:
        nonlocal safe
        if stack and (stack[-1] == "]" or "]" not in stack):
            safe = (end, "".join(reversed(stack)))

    while at < n:
        c = text[at]
        if c in "{[":
            stack.append("}" if c == "{" else "]")
            keys.append(c == "{")
            if len(stack) == 1 or (c == "[" and "]" not in stack[:-1]):
                safe = (at + 1, "".join(reversed(stack)))
            at += 1
        elif c in "}]":
            if not stack or stack[-1] != c:
                break
            stack.pop()
            keys.pop()
            at += 1
            ended(at)
        elif c == '"':
            end = at + 1
            while end < n and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            if end >= n:
                break
            at = end + 1
            if not (keys and keys[-1]):
                ended(at)
        elif c == ":":
            if keys:
                keys[-1] = False
            at += 1
        elif c == ",":
            if keys:
                keys[-1] = stack[-1] == "}"
            at += 1
        elif c.isspace():
            at += 1
        else:  # a number or a word ends where something else begins
            end = at
            while end < n and text[end] not in ",]}: \t\r\n":
                end += 1
            if end >= n:
                break
            at = end
            ended(at)
    if safe is None:
        return None
    kept = text[: safe[0]] + safe[1]
    return kept if is_json(kept) else None


def continued(rows: DataFrame, key: str, prompt: str, model: Callable[[list[str]], list[str | None]], ask: Callable[[str, str], str], rounds: int = ROUNDS) -> DataFrame:
    """(key, text, rounds, whole): answers of ``model``, asked again with what came until they are whole JSON, at most ``rounds`` times.

    ``ask`` (prompt, text so far) makes the next question; the model's answer to it is what
    follows. A round's answers are written, and the next has the open rows only. An answer that
    fails (None, or a batch that raises) leaves its text as it was.
    """
    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, prompt string, text string, rounds int, whole boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            asked = [p if not t else ask(p, t[-REPEATED:]) for p, t in zip(pdf["prompt"], pdf["text"], strict=True)]
            try:
                came = list(model(asked)) if asked else []
            except Exception:  # noqa: BLE001  (the rows stay open)
                came = [None] * len(asked)
            text = [t + (c or "") for t, c in zip(pdf["text"], came, strict=True)]
            yield pdf.assign(text=text, rounds=pdf["rounds"] + 1, whole=[is_json(t) for t in text])

    open_rows = rows.select(key, F.col(prompt).alias("prompt"), F.lit("").alias("text"), F.lit(0).alias("rounds"), F.lit(False).alias("whole"))
    closed = []
    for _ in range(rounds):
        answered = written(open_rows.mapInPandas(run, schema), "round")
        closed.append(answered.where("whole"))
        open_rows = answered.where("not whole")
        if open_rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, [*closed, open_rows]).select(key, "text", "rounds", "whole")


def salvaged(text: Column) -> Column:
    """``whole_elements`` of a column."""
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else whole_elements(t)), "string")(text)


def backfilled(found: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that an answer has, and for all other keys those of the raw data; ``from_raw`` tells which."""
    missing = raw.join(found.select(*keys), keys, "left_anti")
    return found.withColumn("from_raw", F.lit(False)).unionByName(missing.withColumn("from_raw", F.lit(True)))

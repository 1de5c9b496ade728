"""Model calls as one batched transform with an injected function."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def called(rows: DataFrame, column: str, model: Callable[[list[str]], list[str | None]], tries: int = 4, wait: Callable[[str, int], float] | None = None) -> DataFrame:
    """``rows`` with ``result`` and ``result_status``; ``model`` gets batches of texts.

    A batch that fails is tried again after ``wait`` (error message, try) seconds,
    by default what the message asks for, else two seconds a try; then its rows are
    tried one by one, so that one bad text fails alone.
    """
    schema = f"{rows._jdf.schema().toDDL()}, result string, result_status string"
    pause = wait or waiting_seconds

    def answers(texts: list[str], times: int) -> list[str | None]:
        for k in range(1, times + 1):
            try:
                return list(model(texts))
            except Exception as error:  # noqa: BLE001  (any failure of the service is tried again)
                if k < times:
                    time.sleep(pause(str(error), k))
        return [x for t in texts for x in answers([t], 1)] if len(texts) > 1 else [None]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = answers(pdf[column].tolist(), tries) if len(pdf) else []
            yield pdf.assign(result=found, result_status=["failed" if x is None else "done" for x in found])

    return rows.mapInPandas(run, schema)


def waiting_seconds(message: str, attempt: int) -> float:
    """Seconds that an error asks to wait (120 at most), else two for each attempt so far."""
    hint = re.search(r'(?i)retry in (\d+(?:\.\d+)?)\s*s|"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"', message)
    return min(120.0, float(hint[1] or hint[2])) if hint else 2.0 * attempt


def first_that_answers(rows: DataFrame, column: str, models: list[tuple[str, Callable[[str], str]]], continued: Callable[[str, str], str] | None = None, may_pass_on: Callable[[Exception], bool] | None = None, rounds: int = 1) -> DataFrame:
    """``rows`` with result, result_by, result_partial and result_error: models are asked in order until one answers.

    ``models`` are (name, function of one text). A failure for which ``may_pass_on``
    holds (all, by default) goes to the next model. One with a ``partial`` attribute
    hands over what came: ``continued`` (text, partial) makes the next question, and
    the same model may go on for ``rounds`` rounds first.
    """
    schema = f"{rows._jdf.schema().toDDL()}, result string, result_by string, result_partial string, result_error string"

    def answer(text: str) -> tuple[str | None, str | None, str | None, str | None]:
        partial, message = None, None
        for name, model in models:
            for _ in range(max(1, rounds)):
                asked = continued(text, partial) if partial and continued else text
                try:
                    return model(asked), name, partial, None
                except Exception as error:  # noqa: BLE001
                    more, message = getattr(error, "partial", None), str(error)
                    if more and continued:
                        partial = (partial or "") + more
                    elif may_pass_on and not may_pass_on(error):
                        return None, name, partial, message
                    else:
                        break
        return None, None, partial, message

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [answer(t) for t in pdf[column]]
            yield pdf.assign(**{n: [x[k] for x in found] for k, n in enumerate(("result", "result_by", "result_partial", "result_error"))})

    return rows.mapInPandas(run, schema)


def failure_kind(status: Column, message: Column) -> Column:
    """What a failed model call means: quota, unavailable, json, network, auth, server, truncated or other."""
    low = F.lower(F.coalesce(message, F.lit("")))
    # Phrases of service errors.
    phrases = {
        "quota": ("quota", "resource_exhausted", "rate limit", "insufficient balance"),
        "unavailable": ("unavailable", "high demand"),
        "json": ("json", "unterminated string", "unexpected token"),
        "network": ("terminated", "socket", "other side closed", "fetch failed", "network", "timeout", "aborted", "econnreset", "econnrefused", "etimedout", "enotfound", "eai_again"),
        "auth": ("invalid_api_key", "incorrect api key"),
        "truncated": ("max_tokens", "maximum context", "output length", "truncated"),
    }
    codes = {"quota": status.isin(402, 429), "unavailable": status == 503, "auth": status.isin(401, 403)}
    out = F.when(status >= 500, "server").otherwise("other")
    for kind in reversed(phrases):
        hit = codes.get(kind, F.lit(False))
        for phrase in phrases[kind]:
            hit = F.coalesce(hit, F.lit(False)) | low.contains(phrase)
        out = F.when(hit, kind).otherwise(out)
    return out


def retry_delay_ms(message: Column) -> Column:
    """Milliseconds that an error asks to wait, 120 seconds at most; null without a hint."""
    seconds = F.coalesce(*[F.nullif(F.regexp_extract(message, p, 1), F.lit("")) for p in (r"(?i)retry in (\d+(?:\.\d+)?)\s*s", r'(?i)"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"')])
    return F.least(F.ceil(seconds.cast("double") * 1000), F.lit(120_000))

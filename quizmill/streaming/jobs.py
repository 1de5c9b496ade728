"""Import jobs as a stream of wanted states: allowed moves, refused ones, and jobs that stand still."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The states that may follow each state; a job starts without one.
FOLLOWS = {
    None: {"QUEUED"},
    "QUEUED": {"EXTRACTING", "FAILED"},
    "EXTRACTING": {"CLASSIFYING", "FAILED"},
    "CLASSIFYING": {"REVIEW_REQUIRED", "IMPORTING", "FAILED"},
    "REVIEW_REQUIRED": {"IMPORTING", "FAILED"},
    "IMPORTING": {"IMPORTING", "REVIEW_REQUIRED", "DONE", "FAILED"},
    "FAILED": {"IMPORTING"},
    "DONE": set(),
}
#: States in which a job works; standing still in one for IDLE_MS fails it.
WORKING = ("QUEUED", "EXTRACTING", "CLASSIFYING", "IMPORTING")
IDLE_MS = 30 * 60 * 1_000

_COLUMNS = ["job_id", "at_ms", "wanted", "before", "after", "accepted", "reason"]


def _fold(job, status: str | None, since: int, events: list[tuple[int, str]], idle: int, until: int | None) -> tuple[list[tuple], str | None, int]:
    """(moves, state, its time) after a job's events in order of time; ``until`` is the time up to which nothing else came."""
    out: list[tuple] = []

    def stood_still(now: int) -> bool:
        return status in WORKING and now - since > idle

    def failed() -> tuple[str, int]:
        out.append((job, since + idle, "FAILED", status, "FAILED", True, "timeout"))
        return "FAILED", since + idle

    for at, wanted in events:
        if stood_still(at):
            status, since = failed()
        if status is not None and at < since:
            out.append((job, at, wanted, status, status, False, "late"))
        elif wanted in FOLLOWS[status]:
            out.append((job, at, wanted, status, wanted, True, None))
            status, since = wanted, at
        else:
            out.append((job, at, wanted, status, status, False, "not allowed"))
    if until is not None and stood_still(until):
        status, since = failed()
    return out, status, since


def _schema(events: DataFrame) -> str:
    return f"job_id {events.schema['job_id'].dataType.simpleString()}, at_ms long, wanted string, before string, after string, accepted boolean, reason string"


def _timed(moves: DataFrame) -> DataFrame:
    return moves.select("job_id", F.timestamp_millis("at_ms").alias("at"), *_COLUMNS[2:])


def moves(events: DataFrame, idle_ms: int = IDLE_MS, until=None) -> DataFrame:
    """(job_id, at, wanted, before, after, accepted, reason): every wanted state of a log (job_id, at, wanted), and jobs that stood still.

    ``until`` is a column with the time up to which the log is whole (a constant); without
    it, a job's last state is not timed out. States wanted at the same time count in their
    names' order. A job's events are folded in one task; jobs are many and short.
    """
    rows = events.select("job_id", F.unix_millis("at").alias("at_ms"), "wanted", (F.unix_millis(until) if until is not None else F.lit(None).cast("long")).alias("until"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at_ms", "wanted"], kind="stable")
        end = pdf["until"].iloc[0]
        found = _fold(pdf["job_id"].iloc[0], None, 0, list(zip(pdf["at_ms"].tolist(), pdf["wanted"], strict=True)), idle_ms, None if pd.isna(end) else int(end))[0]
        return pd.DataFrame(found, columns=_COLUMNS)

    return _timed(rows.groupBy("job_id").applyInPandas(run, _schema(events)))


def stream(events: DataFrame, idle_ms: int = IDLE_MS, late: str = "0 seconds") -> DataFrame:
    """``moves`` over a stream of events: each job's state is kept, and a job that stands still fails as the watermark passes.

    Events later than ``late`` are dropped by the watermark; those of one batch are put in order.
    """
    rows = events.withWatermark("at", late).select("job_id", "at", F.unix_millis("at").alias("at_ms"), "wanted")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, since = state.get if state.exists else (None, 0)
        found: list[tuple[int, str]] = []
        if not state.hasTimedOut:
            pdf = pd.concat(list(frames), ignore_index=True).sort_values(["at_ms", "wanted"], kind="stable")
            found = list(zip(pdf["at_ms"].tolist(), pdf["wanted"], strict=True))
        out, status, since = _fold(key[0], status, since, found, idle_ms, state.getCurrentWatermarkMs())
        if status is not None:
            state.update((status, since))
            if status in WORKING:
                state.setTimeoutTimestamp(since + idle_ms + 1)
        yield pd.DataFrame(out, columns=_COLUMNS)

    return _timed(rows.groupBy("job_id").applyInPandasWithState(run, _schema(events), "status string, since long", "append", GroupStateTimeout.EventTimeTimeout))

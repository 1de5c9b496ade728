"""Typed model calls: a request builder and a response schema for each task, over one batched call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.model import REQUIRED_ROLES
from quizmill.operators.coercion import box_of
from quizmill.plans import enrich


@dataclass(frozen=True)
class Task:
    """``inputs`` are the columns that a request needs, ``schema`` the answer's (DDL); ``items`` is its array of items, if it has one.

    ``checks`` are conditions on an item by name; the first that does not hold is its error.
    """

    name: str
    rules: str
    inputs: tuple[str, ...]
    schema: str
    items: str | None = None
    checks: dict[str, Callable[[Column], Column]] = field(default_factory=dict)

    def requests(self, rows: DataFrame, key: str) -> DataFrame:
        """(task, key, prompt): the task's rules and the row's inputs, as JSON."""
        prompt = F.to_json(F.struct(F.lit(self.name).alias("task"), F.lit(self.rules).alias("rules"), F.struct(*self.inputs).alias("input")))
        return rows.select(F.lit(self.name).alias("task"), F.col(key).cast("string").alias("key"), prompt.alias("prompt"))

    def answers(self, asked: DataFrame) -> DataFrame:
        """(key, item, error): an answer's items, or one row with the error of an answer that is none."""
        mine = asked.where(F.col("task") == self.name)
        parsed = F.from_json("result", self.schema)
        shaped = parsed[self.items].isNotNull() if self.items else F.coalesce(*[parsed[c.split()[0]] for c in self.schema.split(", ")[:1]]).isNotNull()
        rows = mine.select("key", "result_status", "result", parsed.alias("_a"), shaped.alias("_ok"))
        bad = F.when(F.col("result_status") != "done", "no answer").when(F.try_parse_json("result").isNull(), "not JSON").when(F.col("_a").isNull() | ~F.coalesce("_ok", F.lit(False)), "shape")
        rows = rows.withColumn("_bad", bad)
        good = rows.where("_bad is null").select("key", (F.explode(f"_a.{self.items}") if self.items else F.col("_a")).alias("item"))
        error = F.lit(None).cast("string")
        for name, check in reversed(self.checks.items()):
            error = F.when(F.coalesce(check(F.col("item")), F.lit(False)), error).otherwise(name)
        failed = rows.where("_bad is not null").select("key", F.lit(None).cast(good.schema["item"].dataType).alias("item"), F.col("_bad").alias("error"))
        return good.withColumn("error", error).unionByName(failed)


ANSWER_KEY = Task(
    "answer_key", "List every question number with its answer letter.", ("text",), "answers array<struct<number:int,letter:string>>", "answers",
    {"number": lambda i: i["number"].between(1, 200), "letter": lambda i: i["letter"].isin("A", "B", "C", "D")},
)
FILE_ROLE = Task(
    "file_role", "Say what the file is for and how sure you are.", ("name", "sample"), "role string, confidence double",
    checks={"role": lambda i: i["role"].isin(*REQUIRED_ROLES, "UNKNOWN"), "confidence": lambda i: i["confidence"].between(0, 1)},
)
GROUP_BOX = Task("group_box", "Give the box around the group's picture or passage.", ("page", "questions"), "bbox array<double>", checks={"box": lambda i: box_of(i["bbox"]).isNotNull()})
PART = Task("part", "Give the part as JSON with partNumber and groups.", ("part_number", "text"), "partNumber int, groups array<string>", checks={"part number": lambda i: i["partNumber"].between(1, 7)})


def asked(requests: list[DataFrame], model: Callable[[list[str]], list[str | None]], **options) -> DataFrame:
    """All requests in one batched call: (task, key, prompt, result, result_status); ``options`` are those of ``enrich.called``."""
    return enrich.called(reduce(DataFrame.unionByName, requests), "prompt", model, **options)

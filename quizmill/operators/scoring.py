"""Scores, attempt history and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizmill.functions.numbers import half_up, skill
from quizmill.model import MOST_PER_SKILL


def attempt_scores(attempts: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Score of every attempt; ``answers`` holds one row per (attempt, question).

    Totals come from one small aggregate per (test, part); only answers meet the
    attempts, never attempts times questions. Unanswered questions count as wrong.
    """
    per_part = questions.withColumn("skill", skill(F.col("part_number"))).where("skill is not null")
    totals = per_part.groupBy("test_id", "part_number").agg(F.count_if(F.col("skill") == "listening").alias("l"), F.count_if(F.col("skill") == "reading").alias("r"))
    by_test = totals.groupBy("test_id").agg(F.sum("l").alias("all_l"), F.sum("r").alias("all_r"))
    part = totals.select("test_id", F.col("part_number").alias("scope_part"), F.col("l").alias("part_l"), F.col("r").alias("part_r"))
    key = per_part.select("question_id", F.col("test_id").alias("q_test"), F.col("part_number").alias("q_part"), "skill", "correct")
    scope = attempts.select("attempt_id", "test_id", "scope_part")
    hit = (
        answers.join(key, "question_id").where(F.upper("selected") == F.upper("correct"))
        .join(scope, "attempt_id")
        .where((F.col("q_test") == F.col("test_id")) & (F.col("scope_part").isNull() | (F.col("scope_part") == F.col("q_part"))))
    )
    correct = hit.groupBy("attempt_id").agg(F.count_if(F.col("skill") == "listening").alias("lc"), F.count_if(F.col("skill") == "reading").alias("rc"))
    rows = attempts.join(by_test, "test_id", "left").join(part, ["test_id", "scope_part"], "left").join(correct, "attempt_id", "left")
    whole = F.col("scope_part").isNull()
    total = lambda name: F.coalesce(F.when(whole, F.col(f"all_{name}")).otherwise(F.col(f"part_{name}")), F.lit(0))
    rows = rows.select(
        "attempt_id", "scope_part", total("l").alias("listening_total"), total("r").alias("reading_total"),
        F.coalesce("lc", F.lit(0)).alias("listening_correct"), F.coalesce("rc", F.lit(0)).alias("reading_correct"),
    )
    score = lambda name: F.when(F.col(f"{name}_total") > 0, half_up(F.col(f"{name}_correct") / F.col(f"{name}_total") * MOST_PER_SKILL)).otherwise(0).cast("long")
    rows = rows.withColumn("listening_score", score("listening")).withColumn("reading_score", score("reading"))
    return rows.withColumn("total_score", F.col("listening_score") + F.col("reading_score"))


def admin_stats(attempts: DataFrame) -> DataFrame:
    done = F.col("status") == "COMPLETED"
    return attempts.agg(
        F.count("*").alias("attempts"), F.count_if(done).alias("completed"),
        F.coalesce(half_up(F.avg(F.when(done, F.col("score")))), F.lit(0)).cast("long").alias("mean_score"),
    )


def history(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """Attempts that a user's history shows: of started ones only the newest per test, and not an empty one next to a completed one."""
    counts = answers.groupBy("attempt_id").agg(F.count("*").alias("n_answers"))
    order = Window.partitionBy("user_id", "test_id", "status").orderBy(F.desc("started_at"), F.desc("attempt_id"))
    of_test = Window.partitionBy("user_id", "test_id")
    rows = attempts.join(counts, "attempt_id", "left").withColumn("n_answers", F.coalesce("n_answers", F.lit(0)))
    rows = rows.withColumn("done", F.max((F.col("status") == "COMPLETED").cast("int")).over(of_test)).withColumn("rn", F.row_number().over(order))
    started = F.col("status") == "STARTED"
    return rows.where(~started | ((F.col("rn") == 1) & ~((F.col("done") == 1) & (F.col("n_answers") == 0)))).drop("done", "rn")


def resumed(attempts: DataFrame) -> DataFrame:
    """Started attempts with what a new start does to them: the newest per (user, test) is resumed, older ones go."""
    order = Window.partitionBy("user_id", "test_id").orderBy(F.desc("started_at"), F.desc("attempt_id"))
    rows = attempts.where("status = 'STARTED'").withColumn("rn", F.row_number().over(order))
    return rows.withColumn("action", F.when(F.col("rn") == 1, "resume").otherwise("delete")).drop("rn")


def enrichment_batch(words: DataFrame, enriched: DataFrame, key: str, batch: int) -> DataFrame:
    """Status of every word after one enrichment call, which takes the first ``batch`` words of a key in id order.

    A word succeeds when its lower-case form was among those taken and an
    enrichment for it came back.
    """
    low = words.withColumn("low", F.lower("word"))
    taken = low.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("word_id"))).where(F.col("rn") <= batch)
    sent = taken.select(key, "low").distinct().join(enriched.select("low").distinct(), "low", "left_semi").withColumn("hit", F.lit(True))
    return low.join(sent, [key, "low"], "left").withColumn("status", F.when(F.col("hit"), "done").otherwise("failed")).drop("hit", "low")

"""Roles of uploaded files, review flags and structure checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.functions.numbers import clamp, part_of_number
from quizmill.model import REQUIRED_ROLES, REVIEW_BELOW, expected_counts

# Words that tell a file's role, and how sure each rule is.
READING_WORDS = ("part 5", "part 6", "part 7", "incomplete sentences", "reading")
LISTENING_WORDS = ("transcript", "part 1", "part 2", "part 3", "part 4", "listening")
KEY_WORDS = ("answer key", "101", "200", "a b c d")


def holds_any(c: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return found


def roles(files: DataFrame, reading=READING_WORDS, listening=LISTENING_WORDS, keys=KEY_WORDS) -> DataFrame:
    """``files`` (name, mime_type, text) with role and confidence: the first rule that holds decides."""
    n, t = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    rules = [
        (F.coalesce(F.col("mime_type"), F.lit("")).startswith("audio/") | n.endswith(".mp3"), "AUDIO_FILE", 1.0),
        (holds_any(n, ("key rc", "reading key")), "READING_KEY_IMAGE", 0.92),
        (holds_any(n, ("key lc", "transcript")), "LISTENING_KEY_DOC", 0.92),
        (holds_any(t, reading), "EXAM_DOC", 0.82),
        (holds_any(t, listening), "LISTENING_KEY_DOC", 0.78),
        (holds_any(t, keys), "READING_KEY_IMAGE", 0.7),
    ]
    role, sure = F.lit("UNKNOWN"), F.lit(0.35)
    for when, name, confidence in reversed(rules):
        role, sure = F.when(when, name).otherwise(role), F.when(when, confidence).otherwise(sure)
    return files.withColumn("role", role).withColumn("confidence", sure)


def merged(rule: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """Rule roles, replaced by a model's where its confidence is at least as high; confidence stays in 0..1."""
    m = model.select(key, F.col("role").alias("m_role"), clamp(F.col("confidence"), 0.0, 1.0).alias("m_confidence"))
    takes = F.col("m_confidence") >= F.col("confidence")
    rows = rule.join(m, key, "left")
    return rows.select(key, F.when(takes, F.col("m_role")).otherwise(F.col("role")).alias("role"), F.when(takes, F.col("m_confidence")).otherwise(F.col("confidence")).alias("confidence"))


def review(files: DataFrame, key: str, below: float = REVIEW_BELOW) -> DataFrame:
    """Per job: mean confidence, missing required roles, and whether a person must look."""
    has = [F.bool_or(F.col("role") == role).alias(role) for role in REQUIRED_ROLES]
    jobs = files.groupBy(key).agg((F.sum("confidence") / F.greatest(F.count("*"), F.lit(1))).alias("mean_confidence"), F.bool_or(F.col("role") == "UNKNOWN").alias("unknown"), *has)
    missing = sum((F.when(F.col(role), 0).otherwise(1) for role in REQUIRED_ROLES), F.lit(0))
    jobs = jobs.withColumn("missing_roles", missing)
    return jobs.select(key, "mean_confidence", "missing_roles", ((F.col("mean_confidence") < below) | (F.col("missing_roles") > 0) | F.col("unknown")).alias("needs_review"))


def violations(questions: DataFrame, options: DataFrame, key: str) -> DataFrame:
    """(key, question_number, rule) of every broken rule: number range, repeated number, no text, too few options."""
    counts = options.groupBy(key, "question_number").agg(F.count("*").alias("n_options"))
    seen = questions.groupBy(key, "question_number").agg(F.count("*").alias("n"), F.max(F.length(F.trim(F.coalesce("question_text", F.lit(""))))).alias("size"))
    rows = seen.join(counts, [key, "question_number"], "left").withColumn("n_options", F.coalesce("n_options", F.lit(0))).withColumn("part", part_of_number(F.col("question_number")))
    least = F.when(F.col("part") == 2, 3).otherwise(4)
    rules = F.array_compact(F.array(
        F.when(F.col("part").isNull(), "number"), F.when(F.col("n") > 1, "repeated"), F.when(F.col("size") == 0, "text"), F.when(F.col("n_options") < least, "options"),
    ))
    return rows.select(key, "question_number", F.explode(rules).alias("rule"))


def count_mismatches(questions: DataFrame, key: str) -> DataFrame:
    """(key, part, found, expected) of parts whose number of questions is off."""
    expected = F.create_map(*[F.lit(x) for pair in expected_counts().items() for x in pair])
    counts = questions.withColumn("part", part_of_number(F.col("question_number"))).where("part is not null").groupBy(key, "part").agg(F.count("*").alias("found"))
    return counts.withColumn("expected", F.element_at(expected, F.col("part"))).where("found <> expected")


# Distinct questions that an import needs, those of a full exam, and numbers that a key's reading needs.
LEAST_QUESTIONS, FULL = 185, 200
RULE_KEY, TEXT_KEY = 80, 50


def structure_violations(questions: DataFrame, options: DataFrame, key: str) -> DataFrame:
    """(key, question_number, rule) of a whole exam: the questions' own violations, and the exam's (question_number null or the missing one).

    ``questions`` has part_number (of the group that it stands in), question_number
    and question_text, ``options`` a row an option. Part 2 takes three or four
    options, the others four or more. Under 185 distinct numbers nothing is
    imported; with 200, none may be missing and every part must be exact.
    """
    counts = options.groupBy(key, "question_number").agg(F.count("*").alias("n_options"))
    many = questions.where("part_number = 2").select(key, "question_number").distinct().join(counts, [key, "question_number"]).where("n_options > 4").select(key, "question_number", F.lit("options").alias("rule"))
    outside = questions.where("part_number is null or part_number not between 1 and 7").select(key, "question_number", F.lit("part").alias("rule")).distinct()
    exams = questions.groupBy(key).agg(F.collect_set("question_number").alias("seen"))
    few = exams.where(F.size("seen") < LEAST_QUESTIONS).select(key, F.lit(None).cast("int").alias("question_number"), F.lit("too few").alias("rule"))
    full = exams.where(F.size("seen") >= FULL)
    missing = full.select(key, F.explode(F.array_except(F.sequence(F.lit(1), F.lit(FULL)), "seen")).alias("question_number"), F.lit("missing").alias("rule"))
    expected = F.create_map(*[F.lit(x) for pair in expected_counts().items() for x in pair])
    per = questions.groupBy(key, "part_number").agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("part_number", "n"))).alias("found"))
    off = full.select(key).join(per, key).select(key, F.explode(F.sequence(F.lit(1), F.lit(7))).alias("part"), "found")
    off = off.where(F.coalesce(F.try_element_at("found", F.col("part")), F.lit(0)) != F.element_at(expected, F.col("part"))).select(key, F.lit(None).cast("int").alias("question_number"), F.concat(F.lit("part "), F.col("part").cast("string")).alias("rule"))
    own = violations(questions, options, key)
    out = own
    for more in (many, outside, few, missing, off):
        out = out.unionByName(more)
    return out


def key_route(found: DataFrame, key: str, rule: int = RULE_KEY, text: int = TEXT_KEY) -> DataFrame:
    """(key, n, route): how an answer key is read, by the numbers (key, question_number) found in it: by rule, as text, or by a model."""
    n = F.count("*")
    return found.groupBy(key).agg(n.alias("n"), F.when(n >= rule, "rule").when(n >= text, "text").otherwise("model").alias("route"))

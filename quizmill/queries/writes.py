"""Writes as append logs and the states that follow (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.operators.state import latest, live, or_keep, replaced, upserted, without
from quizmill.registry import query

KEYS = ["user_id", "word"]


def log(t):
    """Word events as a change log: every seventh event deletes."""
    op = F.when(F.col("word_id") % 7 == 0, "delete").otherwise("upsert")
    return t.words().select("user_id", "word", "value", op.alias("op"), F.col("word_id").alias("version"))


_LOG = ", log AS (SELECT user_id, word, value, CASE WHEN word_id % 7 = 0 THEN 'delete' ELSE 'upsert' END AS op, word_id AS version FROM words)"


@query("m1_appended", "SELECT word_id, user_id FROM words UNION ALL SELECT attempt_id + 1000000000, user_id FROM attempts WHERE status = 'STARTED'")
def appended(t):
    new = t.attempts().where("status = 'STARTED'").select((F.col("attempt_id") + 1_000_000_000).alias("word_id"), "user_id")
    return t.words().select("word_id", "user_id").unionByName(new)


@query("m3_default_parts", "SELECT test_id, i::INTEGER AS part_number, title || ' - Part ' || i AS title FROM tests, range(1, 8) r(i)")
def default_parts(t):
    rows = t.tests().withColumn("part_number", F.explode(F.sequence(F.lit(1), F.lit(7))))
    return rows.select("test_id", "part_number", F.concat("title", F.lit(" - Part "), F.col("part_number").cast("string")).alias("title"))


@query("m4_latest_state", _LOG + " SELECT user_id, word, arg_max(value, version) AS value FROM log GROUP BY 1, 2")
def newest(t):
    return latest(log(t).drop("op"), KEYS, "version")


@query("m5_update_where", "SELECT attempt_id, CASE WHEN status = 'STARTED' AND test_id = 1 THEN 'EXPIRED' ELSE status END AS status FROM attempts")
def update_where(t):
    return t.attempts().select("attempt_id", F.when((F.col("status") == "STARTED") & (F.col("test_id") == 1), "EXPIRED").otherwise(F.col("status")).alias("status"))


@query("m6_upsert", _LOG + """,
cur AS (SELECT user_id, word, value, version FROM log WHERE version % 2 = 0), chg AS (SELECT user_id, word, -value AS value, version FROM log WHERE version % 2 = 1)
SELECT user_id, word, arg_max(value, version) AS value FROM (SELECT * FROM cur UNION ALL SELECT * FROM chg) GROUP BY 1, 2
""")
def upsert(t):
    rows = log(t).drop("op")
    return upserted(rows.where("version % 2 = 0"), rows.where("version % 2 = 1").withColumn("value", -F.col("value")), KEYS, "version")


@query("m7_answer_upsert", "SELECT attempt_id, question_id, selected FROM latest")
def answer_upsert(t):
    return latest(t.answers(), ["attempt_id", "question_id"], "version")


@query("m8_coalescing_update", """,
n AS (SELECT user_id, word, arg_max(props, word_id) AS old FROM words GROUP BY 1, 2), c AS (SELECT user_id, word, arg_max(CASE WHEN word_id % 2 = 0 THEN '' ELSE event END, word_id) AS new FROM (SELECT *, 'v' || word_id AS event FROM words) GROUP BY 1, 2)
SELECT user_id, word, CASE WHEN new IS NOT NULL AND new <> '' THEN new ELSE old END AS context FROM n JOIN c USING (user_id, word)
""")
def coalescing(t):
    new = F.when(F.col("word_id") % 2 == 0, "").otherwise(F.concat(F.lit("v"), F.col("word_id")))
    rows = t.words().groupBy(*KEYS).agg(F.max_by("props", "word_id").alias("old"), F.max_by(new, F.col("word_id")).alias("new"))
    return rows.select(*KEYS, or_keep(F.col("new"), F.col("old")).alias("context"))


@query("m9_delete_live", _LOG + " SELECT user_id, word, value FROM (SELECT user_id, word, arg_max(value, version) AS value, arg_max(op, version) AS op FROM log GROUP BY 1, 2) WHERE op <> 'delete'")
def delete_live(t):
    return live(log(t), KEYS, "version")


@query("m10_delete_where", "SELECT a.attempt_id, a.question_id FROM latest a WHERE a.attempt_id NOT IN (SELECT attempt_id FROM attempts WHERE status = 'STARTED' AND test_id = 3)")
def delete_where(t):
    gone = t.attempts().where("status = 'STARTED' and test_id = 3")
    return without(latest(t.answers(), ["attempt_id", "question_id"], "version"), gone, "attempt_id").select("attempt_id", "question_id")


@query("m12_replace_import", """,
fresh AS (SELECT test_id, part_number, question_id + 1000000 AS question_id FROM questions WHERE part_number IN (5, 6) AND test_id = 2 AND size > 25)
SELECT test_id, part_number, question_id FROM questions q WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.test_id = q.test_id AND f.part_number = q.part_number) UNION ALL SELECT * FROM fresh
""")
def replace_import(t):
    q = t.questions().select("test_id", "part_number", "question_id", "size")
    fresh = q.where("part_number in (5, 6) and test_id = 2 and size > 25").withColumn("question_id", F.col("question_id") + 1_000_000).drop("size")
    return replaced(q.drop("size"), fresh, ["test_id", "part_number"])


@query("m13_is_correct", "SELECT a.attempt_id, a.question_id, upper(a.selected) = upper(q.correct) AS is_correct FROM latest a JOIN questions q USING (question_id)")
def is_correct(t):
    rows = latest(t.answers(), ["attempt_id", "question_id"], "version").join(t.questions().select("question_id", "correct"), "question_id")
    return rows.select("attempt_id", "question_id", (F.upper("selected") == F.upper("correct")).alias("is_correct"))


@query("m14_job_states", """,
s AS (SELECT user_id AS job_id, arg_max(word, word_id) AS state, count(*) AS moves FROM words GROUP BY 1) SELECT job_id, state, moves, state IN ('error', 'view') AS resumable FROM s
""")
def job_states(t):
    rows = t.words().groupBy(F.col("user_id").alias("job_id")).agg(F.max_by("word", "word_id").alias("state"), F.count("*").alias("moves"))
    return rows.withColumn("resumable", F.col("state").isin("error", "view"))

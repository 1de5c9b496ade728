"""Scores and histories (A-2, A-3, W-1, W-2, W-10, J-8, J-9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.functions.numbers import half_up
from quizmill.model import ENRICH_BATCH
from quizmill.operators import scoring
from quizmill.operators.state import latest
from quizmill.registry import query

_SCORE = """,
qs AS (SELECT *, CASE WHEN part_number BETWEEN 1 AND 4 THEN 'l' WHEN part_number BETWEEN 5 AND 7 THEN 'r' END AS skill FROM questions),
tot AS (SELECT a.attempt_id, coalesce(sum((q.skill = 'l')::INT * q.n), 0)::BIGINT AS lt, coalesce(sum((q.skill = 'r')::INT * q.n), 0)::BIGINT AS rt FROM attempts a
  LEFT JOIN (SELECT test_id, part_number, skill, count(*) AS n FROM qs GROUP BY ALL) q ON q.test_id = a.test_id AND (a.scope_part IS NULL OR a.scope_part = q.part_number) GROUP BY a.attempt_id),
cor AS (SELECT a.attempt_id, count(*) FILTER (q.skill = 'l') AS lc, count(*) FILTER (q.skill = 'r') AS rc FROM attempts a JOIN latest s USING (attempt_id)
  JOIN qs q ON q.question_id = s.question_id AND q.test_id = a.test_id AND (a.scope_part IS NULL OR a.scope_part = q.part_number) WHERE s.selected = q.correct GROUP BY a.attempt_id),
sc AS (SELECT a.attempt_id, a.scope_part, lt AS listening_total, rt AS reading_total, coalesce(lc, 0) AS listening_correct, coalesce(rc, 0) AS reading_correct FROM attempts a JOIN tot USING (attempt_id) LEFT JOIN cor USING (attempt_id)),
sd AS (SELECT *, CASE WHEN listening_total > 0 THEN floor(listening_correct / listening_total * 495 + 0.5) ELSE 0 END::BIGINT AS listening_score,
  CASE WHEN reading_total > 0 THEN floor(reading_correct / reading_total * 495 + 0.5) ELSE 0 END::BIGINT AS reading_score FROM sc)
SELECT *, listening_score + reading_score AS total_score FROM sd
"""


def scores(t):
    return scoring.attempt_scores(t.attempts(), t.questions(), latest(t.answers(), ["attempt_id", "question_id"], "version"))


query("a2_attempt_score", _SCORE)(scores)


@query("j9_unanswered", _SCORE.replace("SELECT *, listening_score + reading_score AS total_score FROM sd", "SELECT attempt_id, listening_total + reading_total - listening_correct - reading_correct AS not_correct FROM sd"))
def not_correct(t):
    return scores(t).select("attempt_id", (F.col("listening_total") + F.col("reading_total") - F.col("listening_correct") - F.col("reading_correct")).alias("not_correct"))


@query("a3_admin_stats", """
SELECT count(*) AS attempts, count(*) FILTER (status = 'COMPLETED') AS completed, coalesce(floor(avg(score) FILTER (status = 'COMPLETED') + 0.5), 0)::BIGINT AS mean_score FROM attempts
""")
def admin_stats(t):
    return scoring.admin_stats(t.attempts())


@query("w1_attempt_history", """,
n AS (SELECT a.*, coalesce(c.n, 0) AS n_answers, max((status = 'COMPLETED')::INT) OVER (PARTITION BY user_id, test_id) AS done,
  row_number() OVER (PARTITION BY user_id, test_id, status ORDER BY started_at DESC, a.attempt_id DESC) AS rn FROM attempts a LEFT JOIN (SELECT attempt_id, count(*) AS n FROM answers GROUP BY 1) c USING (attempt_id))
SELECT attempt_id, user_id, test_id, status, n_answers FROM n WHERE status <> 'STARTED' OR (rn = 1 AND NOT (done = 1 AND n_answers = 0))
""")
def history(t):
    return scoring.history(t.attempts(), t.answers()).select("attempt_id", "user_id", "test_id", "status", "n_answers")


@query("w2_resume_attempts", """
SELECT attempt_id, user_id, test_id, CASE WHEN row_number() OVER (PARTITION BY user_id, test_id ORDER BY started_at DESC, attempt_id DESC) = 1 THEN 'resume' ELSE 'delete' END AS action FROM attempts WHERE status = 'STARTED'
""")
def resume(t):
    return scoring.resumed(t.attempts()).select("attempt_id", "user_id", "test_id", "action")


@query("w10_enrichment_batch", f""",
lo AS (SELECT word_id, user_id, lower(word) AS low, row_number() OVER (PARTITION BY user_id ORDER BY word_id) AS rn FROM words),
hit AS (SELECT DISTINCT user_id, low FROM lo WHERE rn <= {ENRICH_BATCH} AND low <> 'login')
SELECT word_id, lo.user_id, CASE WHEN hit.low IS NOT NULL THEN 'done' ELSE 'failed' END AS status FROM lo LEFT JOIN hit ON hit.user_id = lo.user_id AND hit.low = lo.low
""")
def enrichment(t):
    words = t.words()
    known = words.select(F.lower("word").alias("low")).distinct().where("low <> 'login'")
    return scoring.enrichment_batch(words, known, "user_id", ENRICH_BATCH).select("word_id", "user_id", "status")


@query("j8_scope_questions", """,
direct AS (SELECT question_id, part_number FROM questions WHERE size <= 30),
grouped AS (SELECT q.question_id, q.part_number FROM questions q JOIN (SELECT DISTINCT group_name, part_number FROM questions WHERE size > 20) g USING (group_name, part_number))
SELECT * FROM direct UNION SELECT * FROM grouped
""")
def scope_questions(t):
    q = t.questions()
    groups = q.where("size > 20").select("group_name", "part_number").distinct()
    by_group = q.join(groups, ["group_name", "part_number"], "left_semi")
    return q.where("size <= 30").select("question_id", "part_number").union(by_group.select("question_id", "part_number")).distinct()


@query("a17_step_counters", "SELECT user_id, count(*) FILTER (word = 'view') AS skipped, count(*) AS steps FROM words GROUP BY user_id")
def step_counters(t):
    return t.words().groupBy("user_id").agg(F.count_if(F.col("word") == "view").alias("skipped"), F.count("*").alias("steps"))


@query("ma1_half_up", "SELECT word_id, floor(-value + 0.5)::BIGINT AS down, floor(value * 2 + 0.5)::BIGINT AS twice FROM words")
def rounding(t):
    return t.words().select("word_id", half_up(-F.col("value")).alias("down"), half_up(F.col("value") * 2).alias("twice"))

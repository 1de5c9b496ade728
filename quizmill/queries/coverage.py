"""Coverage, gaps, counts and windows (A-4, A-5, A-10 to A-16, J-16, J-19, W-3 to W-9, S-4, S-8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quizmill.functions.numbers import part_of_number
from quizmill.model import PART_RANGES
from quizmill.operators import classify, coverage
from quizmill.operators.coercion import with_numbers
from quizmill.operators.extraction import first_seen
from quizmill.plans.stages import job_summary
from quizmill.registry import query

PARTS = "(VALUES " + ", ".join(f"({p}, {a}, {b})" for p, (a, b, _) in PART_RANGES.items()) + ") p(part_number, first, last)"


def numbers(t):
    """Numbers found per user: a stand-in for what a parse of one exam yields."""
    return t.attempts().select("user_id", (F.col("attempt_id") % 200 + 1).cast("int").alias("question_number"))


_FOUND = ", found AS (SELECT user_id, (attempt_id % 200 + 1)::INTEGER AS question_number FROM attempts)"


@query("j19_missing_numbers", _FOUND + f"""
SELECT k.user_id, p.part_number, n.i::INTEGER AS question_number FROM (SELECT DISTINCT user_id FROM found) k, {PARTS}, range(1, 201) n(i)
WHERE n.i BETWEEN p.first AND p.last AND NOT EXISTS (SELECT 1 FROM found f WHERE f.user_id = k.user_id AND f.question_number = n.i)
""")
def missing(t):
    return coverage.missing_numbers(numbers(t), "user_id")


@query("a11_gap_islands", _FOUND + """,
d AS (SELECT DISTINCT user_id, question_number AS n FROM found), g AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS island FROM d),
r AS (SELECT user_id, min(n) AS a, max(n) AS b FROM g GROUP BY user_id, island)
SELECT user_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY user_id
""")
def islands(t):
    return coverage.islands(numbers(t), "user_id", "question_number")


@query("a10_parse_summary", f""",
found AS (SELECT question_number FROM questions GROUP BY 1 HAVING avg(size) > 25),
e AS (SELECT p.part_number, n.i AS n FROM {PARTS}, range(1, 201) n(i) WHERE n.i BETWEEN p.first AND p.last),
m AS (SELECT e.*, n - row_number() OVER (PARTITION BY part_number ORDER BY n) AS island FROM e WHERE n NOT IN (SELECT question_number FROM found)),
r AS (SELECT part_number, min(n) AS a, max(n) AS b FROM m GROUP BY part_number, island),
s AS (SELECT part_number, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS missing FROM r GROUP BY 1)
SELECT e.part_number, count(f.question_number) AS parsed, count(*) AS expected, coalesce(any_value(s.missing), '—') AS missing FROM e LEFT JOIN found f ON f.question_number = e.n LEFT JOIN s ON s.part_number = e.part_number GROUP BY e.part_number
""")
def summary(t):
    found = t.questions().groupBy("question_number").agg(F.avg("size").alias("mean")).where("mean > 25").select("question_number")
    return coverage.parse_summary(found, t.spark)


@query("a4_mean_confidence", "SELECT user_id, sum(value) / greatest(count(*), 1) AS confidence FROM words GROUP BY user_id")
def mean_confidence(t):
    return t.words().groupBy("user_id").agg((F.sum("value") / F.greatest(F.count("*"), F.lit(1))).alias("confidence"))


@query("a5_required_kinds", "SELECT user_id, bool_or(word = 'click') AND bool_or(word = 'view') AS complete, bool_or(word = 'error') AS any_unknown FROM words GROUP BY user_id")
def required_kinds(t):
    has = lambda w: F.bool_or(F.col("word") == w)
    return t.words().groupBy("user_id").agg((has("click") & has("view")).alias("complete"), has("error").alias("any_unknown"))


@query("a6_question_totals", "SELECT test_id, part_number, count(*) AS questions, count(DISTINCT group_name) AS groups FROM questions GROUP BY ALL")
def totals(t):
    return t.questions().groupBy("test_id", "part_number").agg(F.count("*").alias("questions"), F.countDistinct("group_name").alias("groups"))


@query("a12_group_bounds", "SELECT group_name, min(question_number) AS first, max(question_number) AS last FROM questions GROUP BY 1")
def group_bounds(t):
    return t.questions().groupBy("group_name").agg(F.min("question_number").alias("first"), F.max("question_number").alias("last"))


@query("a13_duplicates", "SELECT test_id, count(*) AS n, count(DISTINCT question_number) AS distinct_n, count(*) - count(DISTINCT question_number) AS repeated FROM questions GROUP BY 1")
def duplicates(t):
    rows = t.questions().groupBy("test_id").agg(F.count("*").alias("n"), F.countDistinct("question_number").alias("distinct_n"))
    return rows.withColumn("repeated", F.col("n") - F.col("distinct_n"))


@query("a14_count_mismatches", f"SELECT q.test_id, p.part_number::INTEGER AS part, count(*) AS found, (p.last - p.first + 1)::INTEGER AS expected FROM questions q JOIN {PARTS} ON q.question_number BETWEEN p.first AND p.last GROUP BY ALL HAVING count(*) <> p.last - p.first + 1")
def mismatches(t):
    return classify.count_mismatches(t.questions(), "test_id")


@query("a15_median", "SELECT user_id, median(value) AS mid FROM words GROUP BY 1")
def medians(t):
    return t.words().groupBy("user_id").agg(F.median("value").alias("mid"))


@query("a16_box_bounds", """,
k AS (SELECT vec_id % 50 AS page, x, y, w, h FROM boxes), b AS (SELECT page, min(x) AS x, min(y) AS y, max(x + w) AS x2, max(y + h) AS y2 FROM k GROUP BY 1)
SELECT page, x, y, x2 - x AS w, y2 - y AS h FROM b WHERE x2 - x >= 0.02 AND y2 - y >= 0.02
""")
def box_bounds(t):
    from quizmill.operators.layout import bounds

    return bounds(t.boxes().withColumn("page", F.col("vec_id") % 50), ["page"])


@query("j16_role_merge", """,
r AS (SELECT question_id, 'rule' AS role, (size / 50.0)::DOUBLE AS confidence FROM questions), m AS (SELECT question_id, 'model' AS role, greatest(0.0, least(1.0, (question_number / 150.0)::DOUBLE)) AS confidence FROM questions WHERE question_id % 3 <> 0)
SELECT r.question_id, CASE WHEN m.confidence >= r.confidence THEN m.role ELSE r.role END AS role, CASE WHEN m.confidence >= r.confidence THEN m.confidence ELSE r.confidence END AS confidence FROM r LEFT JOIN m USING (question_id)
""")
def role_merge(t):
    q = t.questions()
    rule = q.select("question_id", F.lit("rule").alias("role"), (F.col("size") / 50.0).alias("confidence"))
    model = q.where("question_id % 3 <> 0").select("question_id", F.lit("model").alias("role"), (F.col("question_number") / 150.0).alias("confidence"))
    return classify.merged(rule, model, "question_id")


@query("w3_sequential_numbers", """,
sq AS (SELECT group_name, question_id, CASE WHEN size % 3 > 0 THEN question_number END AS n FROM questions),
sc AS (SELECT *, sum((n IS NULL)::INT) OVER (PARTITION BY group_name ORDER BY question_id) AS c FROM sq),
sv AS (SELECT *, coalesce(n, c - 1 + greatest(1, coalesce(max(CASE WHEN n IS NOT NULL THEN n + 1 - c END) OVER (PARTITION BY group_name ORDER BY question_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)))::BIGINT AS v FROM sc)
SELECT group_name, string_agg(v::VARCHAR, ',' ORDER BY question_id) AS numbers FROM sv GROUP BY 1
""")
def sequential(t):
    ordered = F.array_sort(F.collect_list(F.struct("question_id", F.when(F.col("size") % 3 > 0, F.col("question_number")).alias("n"))))
    rows = t.questions().groupBy("group_name").agg(F.transform(ordered, lambda s: s["n"]).alias("given"))
    return rows.select("group_name", F.array_join(with_numbers(F.col("given"), F.lit(1)).cast("array<string>"), ",").alias("numbers"))


@query("w4_next_anchor", "SELECT question_id, group_name, lead(question_number) OVER (PARTITION BY group_name ORDER BY question_number, question_id) AS next_number FROM questions")
def next_anchor(t):
    order = Window.partitionBy("group_name").orderBy("question_number", "question_id")
    return t.questions().select("question_id", "group_name", F.lead("question_number").over(order).alias("next_number"))


@query("w6_first_seen", "SELECT user_id, word, word_id FROM words QUALIFY row_number() OVER (PARTITION BY user_id, word ORDER BY created_at, word_id) = 1")
def seen_first(t):
    return first_seen(t.words(), ["user_id", "word"], ["created_at", "word_id"]).select("user_id", "word", "word_id")


@query("w7_last_written", "SELECT question_id, arg_max(selected, (v1, v2, v3, v4)) AS selected FROM answers GROUP BY 1")
def last_written(t):
    return t.answers().groupBy("question_id").agg(F.max_by("selected", "version").alias("selected"))


@query("w8_group_index", f"SELECT q.question_id, p.part_number::INTEGER AS part, floor((q.question_number - p.first) / CASE WHEN p.part_number IN (3, 4) THEN 3 WHEN p.part_number = 6 THEN 4 ELSE 1 END)::BIGINT AS group_index FROM questions q JOIN {PARTS} ON q.question_number BETWEEN p.first AND p.last")
def group_index(t):
    lookup = lambda k: F.create_map(*[F.lit(x) for p, r in PART_RANGES.items() for x in (p, r[k] or 1)])
    rows = t.questions().withColumn("part", part_of_number(F.col("question_number")))
    return rows.select("question_id", "part", F.floor((F.col("question_number") - lookup(0)[F.col("part")]) / lookup(2)[F.col("part")]).alias("group_index"))


@query("w9_running_flag", "SELECT word_id, user_id, max((word = 'view')::INT) OVER (PARTITION BY user_id ORDER BY created_at, word_id ROWS UNBOUNDED PRECEDING) AS inside FROM words")
def running_flag(t):
    order = Window.partitionBy("user_id").orderBy("created_at", "word_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.words().select("word_id", "user_id", F.max((F.col("word") == "view").cast("int")).over(order).alias("inside"))


@query("s8_last_failed_step", """,
s AS (SELECT user_id AS job_id, word AS step, word_id AS ordinal, CASE word_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'done' END AS status FROM words)
SELECT job_id, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'skipped') AS skipped, coalesce(arg_max(step, ordinal) FILTER (status = 'failed'), 'classify') AS last_failed FROM s GROUP BY 1
""")
def last_failed(t):
    status = F.when(F.col("word_id") % 4 == 0, "failed").when(F.col("word_id") % 4 == 1, "skipped").otherwise("done")
    return job_summary(t.words().select(F.col("user_id").alias("job_id"), F.col("word").alias("step"), F.col("word_id").alias("ordinal"), status.alias("status")))


@query("v3_violations", f""",
o AS (SELECT test_id, question_number, sum(size % 6)::BIGINT AS n_options FROM questions WHERE size % 6 > 0 GROUP BY 1, 2),
s AS (SELECT test_id, question_number, count(*) AS n, max(length(question_text)) AS size FROM questions GROUP BY 1, 2),
x AS (SELECT s.*, coalesce(n_options, 0) AS n_options, p.part_number AS part FROM s LEFT JOIN o USING (test_id, question_number) LEFT JOIN {PARTS} ON question_number BETWEEN p.first AND p.last)
SELECT test_id, question_number, 'number' AS rule FROM x WHERE part IS NULL UNION ALL SELECT test_id, question_number, 'repeated' FROM x WHERE n > 1
UNION ALL SELECT test_id, question_number, 'text' FROM x WHERE size = 0 UNION ALL SELECT test_id, question_number, 'options' FROM x WHERE n_options < CASE WHEN part = 2 THEN 3 ELSE 4 END
""")
def violations(t):
    q = t.questions()
    options = q.where("size % 6 > 0").select("test_id", "question_number", F.explode(F.sequence(F.lit(1), F.col("size") % 6)).alias("k"))
    return classify.violations(q, options, "test_id")


@query("v4_missing_roles", """,
f AS (SELECT user_id, CASE word WHEN 'click' THEN 'EXAM_DOC' WHEN 'view' THEN 'AUDIO_FILE' WHEN 'purchase' THEN 'READING_KEY_IMAGE' WHEN 'login' THEN 'LISTENING_KEY_DOC' ELSE 'UNKNOWN' END AS role, value / 100 AS confidence FROM words),
j AS (SELECT user_id, sum(confidence) / count(*) AS mean_confidence, bool_or(role = 'UNKNOWN') AS unknown, 4 - count(DISTINCT role) FILTER (role <> 'UNKNOWN') AS missing_roles FROM f GROUP BY 1)
SELECT user_id, mean_confidence, missing_roles, mean_confidence < 0.9 OR missing_roles > 0 OR unknown AS needs_review FROM j
""")
def review(t):
    table = {"click": "EXAM_DOC", "view": "AUDIO_FILE", "purchase": "READING_KEY_IMAGE", "login": "LISTENING_KEY_DOC"}
    role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col("word")), F.lit("UNKNOWN"))
    return classify.review(t.words().select("user_id", role.alias("role"), (F.col("value") / 100).alias("confidence")), "user_id")


@query("v5_key_quality", "SELECT attempt_id, count(*) AS n, CASE WHEN count(*) >= 6 THEN 'rule' WHEN count(*) >= 3 THEN 'text' ELSE 'model' END AS route FROM answers GROUP BY 1")
def key_quality(t):
    n = F.count("*")
    return t.answers().groupBy("attempt_id").agg(n.alias("n"), F.when(n >= 6, "rule").when(n >= 3, "text").otherwise("model").alias("route"))

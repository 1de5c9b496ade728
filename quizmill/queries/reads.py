"""Lookups, joins, sorts and set operations (F, J, S, U, A-1 to A-9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizmill.operators.extraction import first_seen
from quizmill.operators.state import detached, latest, without
from quizmill.registry import query

KEYS = ["attempt_id", "question_id"]


def answers_now(t) -> DataFrame:
    return latest(t.answers(), KEYS, "version")


@query("f1_attempt_by_id", "SELECT attempt_id, user_id, test_id, status FROM attempts WHERE attempt_id = 7")
def by_id(t):
    return t.attempts().where("attempt_id = 7").select("attempt_id", "user_id", "test_id", "status")


@query("f2_user_by_name", "SELECT user_id, name FROM users WHERE name = 'Customer#000000007'")
def by_name(t):
    return t.users().where("name = 'Customer#000000007'").select("user_id", "name")


@query("f3_word_by_user", "SELECT user_id, word, count(*) AS n FROM words WHERE user_id = 1 AND word = 'click' GROUP BY ALL")
def by_pair(t):
    return t.words().where("user_id = 1 and word = 'click'").groupBy("user_id", "word").agg(F.count("*").alias("n"))


@query("f4_first_match", "SELECT test_id, arg_min(attempt_id, (started_at, attempt_id)) AS attempt_id FROM attempts GROUP BY test_id")
def first_match(t):
    return t.attempts().groupBy("test_id").agg(F.min_by("attempt_id", F.struct("started_at", "attempt_id")).alias("attempt_id"))


@query("f5_started_of_test", "SELECT attempt_id, user_id FROM attempts WHERE status = 'STARTED' AND test_id = 2")
def conjunction(t):
    return t.attempts().where("status = 'STARTED' and test_id = 2").select("attempt_id", "user_id")


@query("f6_not_done", "SELECT word_id, word FROM words WHERE word <> 'click'")
def not_equal(t):
    return t.words().where(F.col("word") != "click").select("word_id", "word")


@query("f7_in_set", "SELECT question_id, part_number FROM questions WHERE part_number IN (3, 4)")
def in_set(t):
    return t.questions().where(F.col("part_number").isin(3, 4)).select("question_id", "part_number")


@query("f8_between", "SELECT question_id, size FROM questions WHERE size BETWEEN 10 AND 20")
def between(t):
    return t.questions().where(F.col("size").between(10, 20)).select("question_id", "size")


@query("f9_graphic_questions", "SELECT question_id, question_number, question_text FROM questions WHERE regexp_matches(question_text, 'blue|red', 'i') ORDER BY question_number")
def graphic(t):
    return t.questions().where(F.col("question_text").rlike("(?i)blue|red")).select("question_id", "question_number", "question_text").orderBy("question_number")


@query("f11_visible_tests", "SELECT test_id, title, 'admin' AS role FROM tests UNION ALL SELECT test_id, title, 'user' AS role FROM tests WHERE published")
def visible(t):
    def seen(role: str):
        tests = t.tests()
        return (tests if role == "admin" else tests.where("published")).select("test_id", "title", F.lit(role).alias("role"))

    return seen("admin").unionByName(seen("user"))


@query("f12_optional_part", "SELECT 'all' AS scope, count(*) AS n FROM questions UNION ALL SELECT 'part 5' AS scope, count(*) AS n FROM questions WHERE part_number = 5")
def optional_part(t):
    def scoped(part: int | None):
        q = t.questions()
        return (q if part is None else q.where(F.col("part_number") == part)).agg(F.count("*").alias("n"))

    return scoped(None).select(F.lit("all").alias("scope"), "n").unionByName(scoped(5).select(F.lit("part 5").alias("scope"), "n"))


@query("f15_analysis_view", """
SELECT question_id, CASE WHEN size >= 25 THEN 'done' WHEN size >= 10 THEN 'running' ELSE 'pending' END AS status, CASE WHEN size >= 25 THEN passage END AS explanation FROM questions
""")
def analysis(t):
    status = F.coalesce(F.when(F.col("size") >= 25, "done").when(F.col("size") >= 10, "running"), F.lit("pending"))
    rows = t.questions().withColumn("status", status)
    return rows.select("question_id", "status", F.when(F.col("status") == "done", F.col("passage")).alias("explanation"))


@query("f16_owned", "SELECT w.word_id, w.user_id FROM words w JOIN users u ON u.user_id = w.user_id WHERE u.segment = 'BUILDING'")
def owned(t):
    return t.words().join(t.users().where("segment = 'BUILDING'"), "user_id", "left_semi").select("word_id", "user_id")


@query("f18_allowed_values", "SELECT attempt_id, scope_part BETWEEN 1 AND 7 AND status IN ('STARTED', 'COMPLETED') AS valid FROM attempts WHERE scope_part IS NOT NULL")
def allowed(t):
    rows = t.attempts().where("scope_part is not null")
    return rows.select("attempt_id", (F.col("scope_part").between(1, 7) & F.col("status").isin("STARTED", "COMPLETED")).alias("valid"))


@query("f19_file_mix", """
SELECT source, count(*) FILTER (doc_id % 3 = 0) AS pdfs, count(*) FILTER (doc_id % 3 = 1) AS mp3s, count(*) FILTER (doc_id % 3 = 0) >= 2 AND count(*) FILTER (doc_id % 3 = 1) >= 1 AS complete FROM documents GROUP BY source
""")
def file_mix(t):
    kind = F.col("doc_id") % 3
    rows = t.documents().groupBy("source").agg(F.count_if(kind == 0).alias("pdfs"), F.count_if(kind == 1).alias("mp3s"))
    return rows.withColumn("complete", (F.col("pdfs") >= 2) & (F.col("mp3s") >= 1))


@query("j1_test_overview", """
SELECT t.test_id, t.title, (SELECT count(DISTINCT part_number) FROM questions q WHERE q.test_id = t.test_id) AS parts, (SELECT count(*) FROM questions q WHERE q.test_id = t.test_id) AS questions,
  (SELECT count(*) FROM attempts a WHERE a.test_id = t.test_id AND a.status = 'COMPLETED') AS finished FROM tests t
""")
def overview(t):
    q = t.questions().groupBy("test_id").agg(F.countDistinct("part_number").alias("parts"), F.count("*").alias("questions"))
    a = t.attempts().where("status = 'COMPLETED'").groupBy("test_id").agg(F.count("*").alias("finished"))
    rows = t.tests().join(q, "test_id", "left").join(a, "test_id", "left")
    return rows.select("test_id", "title", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("parts", "questions", "finished")])


@query("j2_test_tree", """
SELECT test_id, part_number, count(*) AS groups, sum(n)::BIGINT AS questions, string_agg(group_name || ':' || ids, ';' ORDER BY group_name) AS tree FROM
  (SELECT test_id, part_number, group_name, count(*) AS n, string_agg(question_id::VARCHAR, ',' ORDER BY question_id) AS ids FROM questions GROUP BY 1, 2, 3) GROUP BY 1, 2
""")
def tree(t):
    """Nested hydration bottom-up: questions into groups, groups into parts; digested to text."""
    ids = F.array_sort(F.collect_list("question_id"))
    groups = t.questions().groupBy("test_id", "part_number", "group_name").agg(ids.alias("ids"))
    groups = groups.withColumn("text", F.concat_ws(":", "group_name", F.array_join(F.col("ids").cast("array<string>"), ",")))
    parts = groups.groupBy("test_id", "part_number").agg(F.count("*").alias("groups"), F.sum(F.size("ids")).cast("long").alias("questions"), F.array_sort(F.collect_list(F.struct("group_name", "text"))).alias("tree"))
    return parts.withColumn("tree", F.array_join(F.transform("tree", lambda g: g["text"]), ";"))


@query("j3_attempt_answers", """
SELECT a.attempt_id, q.question_id, q.part_number, l.selected, l.selected = q.correct AS is_correct, t.title FROM attempts a JOIN latest l USING (attempt_id) JOIN questions q USING (question_id) JOIN tests t ON t.test_id = a.test_id
""")
def attempt_answers(t):
    q = t.questions().select("question_id", "part_number", "correct")
    rows = answers_now(t).join(t.attempts().select("attempt_id", "test_id"), "attempt_id").join(q, "question_id").join(t.tests().select("test_id", "title"), "test_id")
    return rows.select("attempt_id", "question_id", "part_number", "selected", (F.col("selected") == F.col("correct")).alias("is_correct"), "title")


_OPTIONS = ("A", "N", "R")


@query("j4_wrong_answers", """,
o AS (SELECT question_id, unnest(['A', 'N']) AS letter, question_text || ' ' || unnest(['A', 'N']) AS option_text FROM questions)
SELECT l.attempt_id, l.question_id, coalesce(s.option_text, '') AS selected_text, coalesce(c.option_text, '') AS correct_text FROM latest l JOIN questions q USING (question_id)
  LEFT JOIN o s ON s.question_id = l.question_id AND s.letter = upper(l.selected) LEFT JOIN o c ON c.question_id = l.question_id AND c.letter = upper(q.correct) WHERE l.selected <> q.correct
""")
def wrong_answers(t):
    """Wrong answers with both option texts; the third letter has no option row and gives the default."""
    q = t.questions().select("question_id", "correct", "question_text")
    options = q.select("question_id", F.map_from_arrays(F.array(F.lit("A"), F.lit("N")), F.array(*[F.concat_ws(" ", "question_text", F.lit(x)) for x in ("A", "N")])).alias("options"), "correct")
    rows = answers_now(t).join(options, "question_id").where(F.col("selected") != F.col("correct"))
    text = lambda c: F.coalesce(F.try_element_at("options", F.upper(c)), F.lit(""))
    return rows.select("attempt_id", "question_id", text("selected").alias("selected_text"), text("correct").alias("correct_text"))


@query("j5_selected_words", "SELECT w.word_id, w.word, u.name FROM words w JOIN users u USING (user_id)")
def selected_words(t):
    return t.words().join(t.users(), "user_id").select("word_id", "word", "name")


@query("j6_attempt_users", "SELECT a.attempt_id, u.name, t.title FROM attempts a JOIN users u USING (user_id) JOIN tests t ON t.test_id = a.test_id")
def attempt_users(t):
    return t.attempts().join(t.users(), "user_id").join(t.tests(), "test_id").select("attempt_id", "name", "title")


@query("j7_attempt_counts", "SELECT a.attempt_id, t.title, count(l.question_id) AS n_answers FROM attempts a JOIN tests t USING (test_id) LEFT JOIN answers l USING (attempt_id) GROUP BY 1, 2")
def attempt_counts(t):
    n = t.answers().groupBy("attempt_id").agg(F.count("*").alias("n_answers"))
    rows = t.attempts().join(t.tests(), "test_id").join(n, "attempt_id", "left")
    return rows.select("attempt_id", "title", F.coalesce("n_answers", F.lit(0)).alias("n_answers"))


@query("j10_part_groups", "SELECT DISTINCT n.n_name AS part_name, r.r_name AS group_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey")
def part_groups(t):
    n, r = t.raw("nation"), t.raw("region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("part_name"), F.col("r_name").alias("group_name")).distinct()


@query("j11_question_listing", """
SELECT q.question_id, t.title, q.part_number, g.n AS group_size FROM tests t JOIN questions q ON q.test_id = t.test_id LEFT JOIN (SELECT group_name, count(*) AS n FROM questions WHERE size > 10 GROUP BY 1) g USING (group_name)
""")
def question_listing(t):
    groups = t.questions().where("size > 10").groupBy("group_name").agg(F.count("*").alias("group_size"))
    return t.questions().join(t.tests(), "test_id").join(groups, "group_name", "left").select("question_id", "title", "part_number", "group_size")


@query("j12_question_vocabulary", """
SELECT q.question_id, CASE WHEN q.size > 25 THEN q.passage END AS explanation, count(l.selected) AS n_words FROM questions q LEFT JOIN answers l USING (question_id) GROUP BY q.question_id, q.size, q.passage
""")
def question_vocabulary(t):
    n = t.answers().groupBy("question_id").agg(F.count("selected").alias("n_words"))
    rows = t.questions().join(n, "question_id", "left")
    return rows.select("question_id", F.when(F.col("size") > 25, F.col("passage")).alias("explanation"), F.coalesce("n_words", F.lit(0)).alias("n_words"))


@query("j13_job_files", "SELECT user_id, count(*) AS n_files, string_agg(DISTINCT word, ',' ORDER BY word) AS roles, max(created_at) AS last_at FROM words GROUP BY user_id")
def job_files(t):
    return t.words().groupBy("user_id").agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_set("word")), ",").alias("roles"), F.max("created_at").alias("last_at"))


@query("j14_word_enrichment", """,
e AS (SELECT lower(word) AS low, max(value) AS best FROM words WHERE word LIKE '%i%' GROUP BY 1)
SELECT w.word_id, e.best AS meaning, CASE WHEN e.low IS NULL THEN 'failed' ELSE 'done' END AS status FROM words w LEFT JOIN e ON e.low = lower(w.word)
""")
def word_enrichment(t):
    found = t.words().where(F.col("word").contains("i")).groupBy(F.lower("word").alias("low")).agg(F.max("value").alias("meaning"))
    rows = t.words().withColumn("low", F.lower("word")).join(found, "low", "left")
    return rows.select("word_id", "meaning", F.when(F.col("meaning").isNull(), "failed").otherwise("done").alias("status"))


@query("j15_wrong_explanations", """
SELECT l.attempt_id, l.question_id, CASE WHEN q.size > 25 THEN q.passage END AS explanation, CASE WHEN q.size > 25 THEN 'done' ELSE 'failed' END AS status FROM latest l JOIN questions q USING (question_id) WHERE l.selected <> q.correct
""")
def wrong_explanations(t):
    q = t.questions()
    explained = q.where("size > 25").select("question_id", F.col("passage").alias("explanation"))
    rows = answers_now(t).join(q.select("question_id", "correct"), "question_id").where(F.col("selected") != F.col("correct")).join(explained, "question_id", "left")
    return rows.select("attempt_id", "question_id", "explanation", F.when(F.col("explanation").isNull(), "failed").otherwise("done").alias("status"))


@query("j18_append_missing", """,
parsed AS (SELECT question_id, question_text FROM questions WHERE size % 3 <> 0)
SELECT question_id, question_text, 'parsed' AS origin FROM parsed UNION ALL SELECT question_id, question_text, 'raw' AS origin FROM questions q WHERE NOT EXISTS (SELECT 1 FROM parsed p WHERE p.question_id = q.question_id)
""")
def append_missing(t):
    q = t.questions().select("question_id", "question_text", "size")
    parsed = q.where("size % 3 <> 0").drop("size")
    raw = q.drop("size").join(parsed.select("question_id"), "question_id", "left_anti")
    return parsed.withColumn("origin", F.lit("parsed")).unionByName(raw.withColumn("origin", F.lit("raw")))


@query("j22_assets_by_key", """,
a AS (SELECT part_number || '-' || group_name AS key, min(question_id) AS asset FROM questions WHERE size > 30 GROUP BY 1)
SELECT q.question_id, a.asset FROM questions q LEFT JOIN a ON a.key = q.part_number || '-' || q.group_name
""")
def assets_by_key(t):
    keyed = t.questions().withColumn("key", F.concat_ws("-", F.col("part_number"), "group_name"))
    assets = keyed.where("size > 30").groupBy("key").agg(F.min("question_id").alias("asset"))
    return keyed.join(assets, "key", "left").select("question_id", "asset")


@query("j24_cascade_delete", """,
gone AS (SELECT test_id FROM tests WHERE NOT published)
SELECT 'attempt' AS kind, attempt_id AS id, NULL::VARCHAR AS group_name FROM attempts WHERE test_id NOT IN (SELECT test_id FROM gone)
UNION ALL SELECT 'question', question_id, CASE WHEN group_name <> 'Brand#11' THEN group_name END FROM questions WHERE test_id NOT IN (SELECT test_id FROM gone)
""")
def cascade_delete(t):
    gone = t.tests().where("not published")
    groups = t.questions().where("group_name = 'Brand#11'")
    attempts = without(t.attempts(), gone, "test_id").select(F.lit("attempt").alias("kind"), F.col("attempt_id").alias("id"), F.lit(None).cast("string").alias("group_name"))
    questions = detached(without(t.questions(), gone, "test_id"), groups, "group_name").select(F.lit("question").alias("kind"), F.col("question_id").alias("id"), "group_name")
    return attempts.unionByName(questions)


@query("j25_interval_overlap", """,
c AS (SELECT k AS chunk, 147 + k * 7 AS a, least(153 + k * 7, 200) AS b FROM range(8) r(k)), p AS (SELECT question_id, 140 + question_id % 60 AS s, 140 + question_id % 60 + size % 5 AS e FROM questions)
SELECT chunk, question_id FROM c JOIN p ON p.e >= c.a AND p.s <= c.b
""")
def interval_overlap(t):
    chunks = t.spark.range(8).select(F.col("id").alias("chunk"), (147 + F.col("id") * 7).alias("a"), F.least(153 + F.col("id") * 7, F.lit(200)).alias("b"))
    start = 140 + F.col("question_id") % 60
    blocks = t.questions().select("question_id", start.alias("s"), (start + F.col("size") % 5).alias("e"))
    return blocks.join(F.broadcast(chunks), (F.col("e") >= F.col("a")) & (F.col("s") <= F.col("b"))).select("chunk", "question_id")


@query("a1_children_counts", "SELECT u.user_id, count(a.attempt_id) AS n FROM users u LEFT JOIN attempts a USING (user_id) GROUP BY 1")
def children_counts(t):
    n = t.attempts().groupBy("user_id").agg(F.count("*").alias("n"))
    return t.users().join(n, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("a7_part_images", "SELECT part_number, count(*) AS groups, count(*) FILTER (size % 4 = 0) AS with_image FROM questions GROUP BY part_number ORDER BY part_number")
def part_images(t):
    return t.questions().groupBy("part_number").agg(F.count("*").alias("groups"), F.count_if(F.col("size") % 4 == 0).alias("with_image")).orderBy("part_number")


@query("a8_reading_regions", "SELECT part_number, count(*) AS groups, count(*) FILTER (size % 4 = 0) AS with_image, count(*) FILTER (size % 8 = 0) AS with_regions FROM questions WHERE part_number BETWEEN 5 AND 7 GROUP BY 1")
def reading_regions(t):
    rows = t.questions().where(F.col("part_number").between(5, 7))
    return rows.groupBy("part_number").agg(F.count("*").alias("groups"), F.count_if(F.col("size") % 4 == 0).alias("with_image"), F.count_if(F.col("size") % 8 == 0).alias("with_regions"))


@query("a18_prompt_chars", "SELECT conv_id, sum(length(text))::BIGINT AS chars, count(*) AS messages, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def prompt_chars(t):
    return t.raw("conversations").groupBy("conv_id").agg(F.sum(F.char_length("text")).cast("long").alias("chars"), F.count("*").alias("messages"), F.max_by("role", "turn").alias("last_role"))


@query("a20_best_candidate", "SELECT group_name, arg_max(question_id, (size, -question_id)) AS question_id, max(size) AS size FROM questions GROUP BY group_name")
def best_candidate(t):
    return t.questions().groupBy("group_name").agg(F.max_by("question_id", F.struct("size", -F.col("question_id"))).alias("question_id"), F.max("size").alias("size"))


@query("s1_sorted_attempts", "SELECT attempt_id, user_id, started_at FROM attempts ORDER BY started_at DESC, attempt_id")
def sorted_attempts(t):
    return t.attempts().select("attempt_id", "user_id", "started_at").orderBy(F.desc("started_at"), "attempt_id")


@query("s6_top_per_group", "SELECT group_name, question_id FROM questions QUALIFY row_number() OVER (PARTITION BY group_name ORDER BY size DESC, question_number, question_id) = 1")
def top_per_group(t):
    rows = first_seen(t.questions().withColumn("minus", -F.col("size")), ["group_name"], ["minus", "question_number", "question_id"])
    return rows.select("group_name", "question_id")


@query("s7_head_limit", "SELECT question_id, group_name FROM questions QUALIFY row_number() OVER (PARTITION BY group_name ORDER BY question_number, question_id) <= 4")
def head_limit(t):
    order = Window.partitionBy("group_name").orderBy("question_number", "question_id")
    return t.questions().withColumn("rn", F.row_number().over(order)).where("rn <= 4").select("question_id", "group_name")


@query("u1_union_ids", "SELECT question_id FROM questions WHERE size < 20 UNION SELECT question_id FROM answers WHERE selected = 'R'")
def union_ids(t):
    return t.questions().where("size < 20").select("question_id").union(t.answers().where("selected = 'R'").select("question_id")).distinct()


@query("u2_distinct_parts", "SELECT DISTINCT test_id, part_number FROM questions")
def distinct_parts(t):
    return t.questions().select("test_id", "part_number").distinct()


@query("u3_never_answered", "SELECT question_id FROM questions EXCEPT SELECT question_id FROM answers JOIN attempts a USING (attempt_id) WHERE a.status = 'STARTED' AND a.test_id = 3")
def never_answered(t):
    seen = t.answers().join(t.attempts().where("status = 'STARTED' and test_id = 3"), "attempt_id", "left_semi")
    return t.questions().select("question_id").join(seen.select("question_id"), "question_id", "left_anti").distinct()


@query("u4_union_all", "SELECT part_number, count(*) AS n FROM (SELECT part_number FROM questions WHERE size < 30 UNION ALL SELECT part_number FROM questions WHERE size > 20) GROUP BY 1")
def union_all(t):
    q = t.questions()
    return q.where("size < 30").select("part_number").unionByName(q.where("size > 20").select("part_number")).groupBy("part_number").agg(F.count("*").alias("n"))


@query("u5_series", "SELECT i::BIGINT AS n FROM range(101, 201) r(i)")
def series(t):
    return t.spark.range(1).select(F.explode(F.expr("sequence(101L, 200L)")).alias("n"))


@query("u6_range_clip", "SELECT group_name, string_agg(question_number::VARCHAR, ',' ORDER BY question_number, question_id) AS kept FROM questions WHERE question_number BETWEEN 147 AND 200 GROUP BY 1")
def range_clip(t):
    numbers = F.array_sort(F.collect_list("question_number"))
    groups = t.questions().groupBy("group_name").agg(numbers.alias("numbers")).withColumn("kept", F.filter("numbers", lambda n: n.between(147, 200)))
    return groups.where(F.size("kept") > 0).select("group_name", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"))


@query("u7_filtered_map", "SELECT test_id, count(*) AS n, string_agg(question_id || '=' || correct, ',' ORDER BY question_id) AS answer_key FROM questions WHERE question_number > 190 GROUP BY 1")
def filtered_map(t):
    pairs = F.array_sort(F.collect_list(F.struct("question_id", F.struct("question_number", "correct").alias("v"))))
    keys = t.questions().groupBy("test_id").agg(F.map_from_entries(pairs).alias("m")).withColumn("m", F.map_filter("m", lambda k, v: v["question_number"] > 190))
    listed = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"]["correct"]))
    return keys.select("test_id", F.size("m").cast("long").alias("n"), F.array_join(listed, ",").alias("answer_key")).where("n > 0")

"""JSON, arrays, maps, dates and shape coercion (D, MA, AR, MP, JS, N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.functions.numbers import clamp, number_or_null
from quizmill.operators import coercion
from quizmill.operators.extraction import first_seen
from quizmill.registry import query


@query("d2_dates", "SELECT attempt_id, started_at, datediff('day', DATE '1970-01-01', started_at::DATE) * 86400000 AS day_millis, strftime(started_at, '%Y-%m') AS month FROM attempts")
def dates(t):
    return t.attempts().select("attempt_id", "started_at", (F.unix_date(F.to_date("started_at")).cast("long") * 86_400_000).alias("day_millis"), F.date_format("started_at", "yyyy-MM").alias("month"))


@query("ma2_clamps", "SELECT word_id, greatest(0.0::DOUBLE, least(50.0::DOUBLE, value)) AS inside, abs(value - 50) AS apart, floor(value)::BIGINT AS low, ceil(value)::BIGINT AS high FROM words")
def clamps(t):
    v = F.col("value")
    return t.words().select("word_id", clamp(v, 0.0, 50.0).alias("inside"), F.abs(v - 50).alias("apart"), F.floor(v).alias("low"), F.ceil(v).alias("high"))


@query("ma3_numbers", "SELECT question_id, try_cast(CASE WHEN size % 2 = 0 THEN size::VARCHAR ELSE question_text END AS DOUBLE) AS number FROM questions")
def numbers(t):
    raw = F.when(F.col("size") % 2 == 0, F.col("size").cast("string")).otherwise(F.col("question_text"))
    return t.questions().select("question_id", number_or_null(raw).alias("number"))


@query("ar_arrays", """,
w AS (SELECT question_id, string_split(question_text, ' ') AS a FROM questions)
SELECT question_id, array_to_string(list_transform(a, lambda x: upper(x)), ' ') AS mapped, len(list_filter(a, lambda x: length(x) > 4)) AS long_words, list_sum(list_transform(a, lambda x: length(x)))::BIGINT AS total, array_to_string(list_transform(a, lambda x, i: chr(64 + i::INTEGER) || ':' || x), ',') AS lettered FROM w
""")
def arrays(t):
    a = F.split("question_text", " ")
    return t.questions().select(
        "question_id", F.array_join(F.transform(a, F.upper), " ").alias("mapped"), F.size(F.filter(a, lambda x: F.length(x) > 4)).cast("long").alias("long_words"),
        F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("total"), F.array_join(F.transform(a, lambda x, i: F.concat(F.chr(i + 65), F.lit(":"), x)), ",").alias("lettered"),
    )


@query("mp_maps", "SELECT group_name, count(DISTINCT part_number) AS parts, max(question_id) FILTER (part_number = 5) AS of_five FROM questions GROUP BY 1")
def maps(t):
    by_part = t.questions().groupBy("group_name", "part_number").agg(F.max("question_id").alias("q"))
    m = by_part.groupBy("group_name").agg(F.map_from_entries(F.collect_list(F.struct("part_number", "q"))).alias("m"))
    return m.select("group_name", F.size("m").cast("long").alias("parts"), F.try_element_at("m", F.lit(5)).alias("of_five"))


@query("js1_json", "SELECT word_id, (props->>'$.k')::BIGINT AS k FROM words")
def json_props(t):
    fenced = F.when(F.col("word_id") % 2 == 0, F.concat(F.lit("text\n```json\n"), "props", F.lit("\n```"))).otherwise(F.col("props"))
    return t.words().select("word_id", F.try_variant_get(coercion.fenced_json(fenced), "$.k", "bigint").alias("k"))


@query("js2_to_json", """SELECT question_id, '{"question_id":' || question_id || ',"correct":"' || correct || '"}' AS json FROM questions""")
def to_json(t):
    return t.questions().select("question_id", F.to_json(F.struct("question_id", "correct")).alias("json"))


@query("n2_options", """
SELECT question_id, CASE WHEN size % 2 = 0 THEN 'C' ELSE 'A' END AS letter, question_text AS text FROM questions
""")
def options(t):
    raw = F.when(F.col("size") % 2 == 0, F.concat(F.lit(" c) "), "question_text")).otherwise(F.concat(F.col("question_text"), F.lit("\n")))
    return t.questions().select("question_id", coercion.option(raw, F.lit("A")).alias("o")).select("question_id", "o.*")


@query("n3_labelled_options", """,
q AS (SELECT question_id, question_text, group_name, size FROM questions)
SELECT question_id, 'A' AS letter, CASE WHEN size % 3 = 0 THEN question_text ELSE question_text END AS text FROM q UNION ALL SELECT question_id, 'B', group_name FROM q WHERE size % 3 <> 0
""")
def labelled(t):
    raw = F.when(F.col("size") % 3 == 0, F.col("question_text")).otherwise(F.concat(F.lit("(A) "), "question_text", F.lit(" (b) "), "group_name"))
    return t.questions().select("question_id", F.explode(coercion.labelled_options(raw)).alias("o")).select("question_id", "o.*")


@query("n5_stems", "SELECT question_id, question_text AS stem FROM questions")
def stems(t):
    return t.questions().select("question_id", coercion.stem(F.concat(F.lit(" "), "question_text", F.lit(" (A) x (B) y"))).alias("stem"))


@query("n6_questions", """
SELECT question_id, CASE WHEN size % 4 <> 0 THEN question_number END AS question_number, CASE WHEN size % 5 = 0 THEN 'Question ' || CASE WHEN size % 4 <> 0 THEN question_number::VARCHAR ELSE '?' END ELSE question_text END AS question_text, CASE WHEN size % 3 = 0 THEN 'A' ELSE correct END AS correct FROM questions
""")
def questions(t):
    number = F.when(F.col("size") % 4 != 0, F.col("question_number"))
    a = F.to_json(F.struct(number.alias("number"), F.when(F.col("size") % 5 != 0, F.col("question_text")).alias("question"), F.when(F.col("size") % 3 != 0, F.lower("correct")).alias("answer")))
    return t.questions().select("question_id", coercion.question(F.parse_json(a)).alias("q")).select("question_id", "q.*")


@query("n9_dealt_groups", """,
rn AS (SELECT group_name, question_id, row_number() OVER (PARTITION BY group_name ORDER BY question_id) AS r, greatest(1, ceil(count(*) OVER (PARTITION BY group_name) / 4.0))::BIGINT AS size FROM questions),
gk AS (SELECT DISTINCT group_name, k.k FROM questions CROSS JOIN range(0, 4) k(k))
SELECT gk.group_name, gk.k::INTEGER AS part, coalesce(string_agg(rn.question_id::VARCHAR, ',' ORDER BY rn.r), '') AS ids FROM gk LEFT JOIN rn ON rn.group_name = gk.group_name AND rn.r > gk.k * rn.size AND rn.r <= (gk.k + 1) * rn.size GROUP BY 1, 2
""")
def dealt(t):
    ids = F.array_sort(F.collect_list("question_id"))
    rows = t.questions().groupBy("group_name").agg(ids.alias("ids")).select("group_name", F.posexplode(coercion.dealt(F.col("ids"), F.lit(4))).alias("part", "ids"))
    return rows.select("group_name", "part", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("n12_part_seven", "SELECT test_id, question_number, min(question_id) AS question_id FROM questions WHERE question_number BETWEEN 147 AND 200 GROUP BY 1, 2")
def part_seven(t):
    rows = t.questions().where("question_number between 147 and 200")
    return first_seen(rows, ["test_id", "question_number"], ["question_id"]).select("test_id", "question_number", "question_id")


@query("j17_filled_groups", """,
g AS (SELECT group_name || '|' || part_number AS key, string_agg(question_number::VARCHAR, ',' ORDER BY question_number) AS numbers, min(passage) AS raw FROM questions GROUP BY 1)
SELECT key, numbers, CASE WHEN length(key) % 2 = 0 THEN 'given' ELSE raw END AS passage FROM g
""")
def filled(t):
    g = t.questions().groupBy(F.concat_ws("|", "group_name", F.col("part_number").cast("string")).alias("key")).agg(F.sort_array(F.collect_list("question_number"), False).alias("numbers"), F.min("passage").alias("raw"))
    groups = g.select("key", "numbers", F.when(F.length("key") % 2 == 0, "given").otherwise(" ").alias("passage"))
    raw = g.select("key", F.reverse("numbers").alias("numbers"), F.col("raw").alias("passage"))
    rows = coercion.filled_from_raw(groups, raw)
    return rows.select("key", F.array_join(F.array_sort("numbers").cast("array<string>"), ",").alias("numbers"), "passage")

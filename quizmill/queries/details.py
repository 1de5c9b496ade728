"""Projections, sorts, imports, small scalars and state documents (F-10 to F-14, J-21, A-19, S-3, S-5, M-2, M-15, T-8, T-12, T-20, AR, JS, N-8, N-11, L-13, L-14, G-11, P-3, V-2, C-2, C-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.functions.numbers import part_of_number
from quizmill.model import PART_RANGES
from quizmill.operators import coercion, coverage, extraction, graphics
from quizmill.queries.coverage import PARTS
from quizmill.queries.documents import _BOOK, booklets
from quizmill.registry import query


@query("f10_with_scope", "SELECT attempt_id, scope_part FROM attempts WHERE scope_part IS NOT NULL")
def with_scope(t):
    return t.attempts().where(F.col("scope_part").isNotNull()).select("attempt_id", "scope_part")


@query("f13_nested_select", "SELECT a.attempt_id, a.status, u.name FROM attempts a JOIN users u USING (user_id)")
def nested_select(t):
    """A nested object is one struct; the flat result reads its fields."""
    users = t.users().select("user_id", F.struct("name", "segment").alias("user"))
    return t.attempts().join(users, "user_id").select("attempt_id", "status", "user.name")


@query("f14_helper_dropped", "SELECT a.attempt_id, a.user_id FROM attempts a WHERE (SELECT count(*) FROM answers s WHERE s.attempt_id = a.attempt_id) > 0")
def helper_dropped(t):
    counts = t.answers().groupBy("attempt_id").agg(F.count("*").alias("_count"))
    return t.attempts().join(counts, "attempt_id").where("_count > 0").drop("_count").select("attempt_id", "user_id")


@query("j21_passage_pages", _BOOK + " SELECT DISTINCT doc_id, n AS first_question, n AS last_question, floor((pos - 1) / 4)::BIGINT AS page FROM bk QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY pos) = 1")
def passage_pages(t):
    """The first page, of four blocks each, that holds a passage's header."""
    header = r"(?i)Questions?\s+(\d{1,3})\s*-\s*(\d{1,3})"
    blocks = booklets(t).select("doc_id", F.posexplode(F.split("text", r"(?m)^(?=Part \d$)")).alias("at", "text")).where("text <> ''")
    rows = blocks.select("doc_id", F.floor((F.col("at")) / 4).alias("page"), *(F.regexp_extract("text", header, k).cast("int").alias(n) for k, n in ((1, "first_question"), (2, "last_question"))))
    return rows.groupBy("doc_id", "first_question", "last_question").agg(F.min("page").alias("page"))


@query("a19_boxes_per_part", "SELECT part_number, count(*) FILTER (size % 3 = 0) AS with_box, count(*) AS groups FROM questions GROUP BY 1")
def boxes_per_part(t):
    return t.questions().groupBy("part_number").agg(F.count_if(F.col("size") % 3 == 0).alias("with_box"), F.count("*").alias("groups"))


@query("s3_by_two_keys", "SELECT vec_id, row_number() OVER (ORDER BY y, x, vec_id)::INTEGER AS place FROM boxes QUALIFY place <= 50")
def by_two_keys(t):
    """The first fifty spots in reading order: a top-k report."""
    top = t.boxes().orderBy("y", "x", "vec_id").limit(50).select(F.struct("y", "x", "vec_id").alias("s"))
    listed = top.agg(F.array_sort(F.collect_list("s")).alias("l")).select(F.posexplode("l").alias("place", "s"))
    return listed.select("s.vec_id", (F.col("place") + 1).alias("place"))


@query("s3_all_by_two_keys", "SELECT vec_id, x, y FROM boxes ORDER BY y, x, vec_id")
def all_by_two_keys(t):
    """Every box in reading order, by a range-partitioned sort."""
    return t.boxes().select("vec_id", "x", "y").orderBy("y", "x", "vec_id")


@query("s5_ordered_numbers", "SELECT test_id, group_name, string_agg(question_number::VARCHAR, ',' ORDER BY question_number) AS numbers FROM questions GROUP BY 1, 2")
def ordered_numbers(t):
    rows = t.questions().groupBy("test_id", "group_name").agg(F.array_sort(F.collect_list("question_number")).alias("n"))
    return rows.select("test_id", "group_name", F.array_join(F.col("n").cast("array<string>"), ",").alias("numbers"))


@query("m2_inserted_options", "SELECT question_id, unnest(['A', 'B', 'C', 'D']) AS letter FROM questions")
def inserted_options(t):
    return t.questions().select("question_id", F.explode(F.array(*[F.lit(x) for x in "ABCD"])).alias("letter"))


@query("m15_direct_import", f"""
SELECT q.test_id, p.part_number::INTEGER AS part_number, count(*) AS questions, p.part_number <= 4 AS has_audio FROM questions q JOIN {PARTS} ON q.question_number BETWEEN p.first AND p.last GROUP BY ALL
""")
def direct_import(t):
    rows = t.questions().withColumn("part_number", part_of_number(F.col("question_number"))).groupBy("test_id", F.col("part_number")).agg(F.count("*").alias("questions"))
    return rows.withColumn("has_audio", F.col("part_number") <= 4)


@query("t8_position_of_match", "SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{3}') THEN length(string_split_regex(text, '[0-9]{3}')[1]) + 1 ELSE 0 END AS place FROM documents")
def position_of_match(t):
    """1-based place of the first three digits, 0 without any."""
    return t.documents().select("doc_id", F.regexp_instr("text", F.lit("[0-9]{3}")).cast("long").alias("place"))


@query("t12_extensions", "SELECT word_id, lower(word) || '.PDF' AS file, '.PDF' AS extension FROM words")
def extensions(t):
    file = F.concat(F.lit("up/"), F.lower("word"), F.lit(".PDF"))
    return t.words().select("word_id", T.base_name(file).alias("file"), T.extension(file).alias("extension"))


@query("t20_document_like", "SELECT question_id, size % 3 <> 0 AS document_like FROM questions")
def document_like(t):
    mime = F.when(F.col("size") % 3 == 0, "audio/mpeg").when(F.col("size") % 3 == 1, "application/pdf").otherwise("image/png")
    return t.questions().select("question_id", (mime.startswith("image/") | (mime == "application/pdf")).alias("document_like"))


@query("ar2_find_and_exists", "SELECT question_id, list_filter(string_split(question_text, ' '), lambda x: length(x) > 4)[1] AS found, len(list_filter(string_split(question_text, ' '), lambda x: length(x) > 4)) > 0 AS any_long FROM questions")
def find_and_exists(t):
    a = F.split("question_text", " ")
    return t.questions().select("question_id", F.get(F.filter(a, lambda x: F.length(x) > 4), 0).alias("found"), F.exists(a, lambda x: F.length(x) > 4).alias("any_long"))


@query("ar4_inserted", "SELECT question_id, list_aggregate(list_concat(list_concat([string_split(question_text, ' ')[1]], ['new']), string_split(question_text, ' ')[2:]), 'string_agg', '|') AS list FROM questions")
def inserted(t):
    return t.questions().select("question_id", F.array_join(F.array_insert(F.split("question_text", " "), 2, F.lit("new")), "|").alias("list"))


@query("js4_shapes", "SELECT question_id, CASE size % 3 WHEN 0 THEN 'ARRAY' WHEN 1 THEN 'OBJECT' ELSE 'other' END AS shape FROM questions")
def shapes(t):
    raw = F.when(F.col("size") % 3 == 0, F.to_json(F.array("size"))).when(F.col("size") % 3 == 1, F.to_json(F.struct("size"))).otherwise(F.col("size").cast("string"))
    kind = F.regexp_extract(F.schema_of_variant(F.parse_json(raw)), "^(ARRAY|OBJECT)", 1)
    return t.questions().select("question_id", F.when(kind != "", kind).otherwise("other").alias("shape"))


@query("js5_versioned_state", "SELECT word_id, CASE WHEN word_id % 3 < 2 THEN word END AS step FROM words")
def versioned_state(t):
    """A state document counts only with a known version."""
    doc = F.to_json(F.struct((F.col("word_id") % 3 + 1).alias("version"), F.col("word").alias("step")))
    state = F.from_json(doc, "version int, step string")
    return t.words().select("word_id", F.when(state["version"].isin(1, 2), state["step"]).alias("step"))


@query("n8_groups", "SELECT question_id, passage AS passage, CASE WHEN size % 2 = 0 THEN size END AS page FROM questions")
def groups(t):
    raw = F.to_json(F.struct("passage", F.when(F.col("size") % 4 == 0, F.col("size")).alias("sourcePage"), F.when(F.col("size") % 4 == 2, F.col("size")).alias("pageNumber")))
    v = F.parse_json(raw)
    return t.questions().select("question_id", coercion.aliased(v, "passage").alias("passage"), coercion.aliased(v, "sourcePage", "page", "pageNumber", kind="int").alias("page"))


@query("n11_part_entry")
def part_entry(t):
    """Whole parts: numbers continue from the part's first question where they are missing; a fold."""
    first = F.create_map(*[F.lit(x) for p, (a, _, _) in PART_RANGES.items() for x in (p, a)])
    given = F.array_sort(F.collect_list(F.struct("question_id", F.when(F.col("size") % 2 == 0, F.col("question_number")).alias("n"))))
    rows = t.questions().groupBy("test_id", "part_number").agg(F.transform(given, lambda s: s["n"]).alias("given"))
    return rows.select("test_id", "part_number", F.array_join(coercion.with_numbers(F.col("given"), first[F.col("part_number")]).cast("array<string>"), ",").alias("numbers"))


@query("l13_page_groups", "SELECT test_id, size AS page, count(*) AS n, string_agg(DISTINCT question_number::VARCHAR, ',' ORDER BY question_number::VARCHAR) AS numbers FROM questions GROUP BY 1, 2")
def page_groups(t):
    rows = t.questions().groupBy("test_id", F.col("size").alias("page")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.col("question_number").cast("string"))).alias("s"))
    return rows.select("test_id", "page", "n", F.array_join("s", ",").alias("numbers"))


@query("l14_missing_runs", """,
f AS (SELECT DISTINCT group_name, question_number FROM questions WHERE question_number BETWEEN 147 AND 200), d AS (SELECT k.group_name, n.i AS n FROM (SELECT DISTINCT group_name FROM f) k, range(147, 201) n(i) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.group_name = k.group_name AND f.question_number = n.i)),
g AS (SELECT group_name, n, n - row_number() OVER (PARTITION BY group_name ORDER BY n) AS island FROM d), r AS (SELECT group_name, min(n) AS a, max(n) AS b FROM g GROUP BY group_name, island)
SELECT group_name, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY group_name
""")
def missing_runs(t):
    found = t.questions().where("question_number between 147 and 200")
    gaps = coverage.missing_numbers(found, "group_name").where("part_number = 7")
    return coverage.islands(gaps, "group_name", "question_number")


@query("g11_resolved_boxes", "SELECT question_id AS doc_id, question_number AS first_question, CASE WHEN size % 2 = 0 THEN 'own' WHEN size % 3 = 0 THEN 'found' END AS box FROM questions")
def resolved_boxes(t):
    rows = t.questions().select(F.col("question_id").alias("doc_id"), F.col("question_number").alias("first_question"), "size")
    given = rows.select("doc_id", "first_question", F.when(F.col("size") % 2 == 0, "own").alias("box"))
    return graphics.resolved(given, rows.where("size % 3 = 0").select("doc_id", "first_question", F.lit("found").alias("box")))


@query("p3_asset_map", "SELECT test_id, count(*) AS n, string_agg(key || '=' || asset, ';' ORDER BY key) AS entries FROM (SELECT test_id, part_number || '-' || group_name AS key, min(question_id) AS asset FROM questions GROUP BY 1, 2) GROUP BY 1")
def asset_map(t):
    """Keyed assets as a map, and the map back as sorted entries."""
    assets = t.questions().groupBy("test_id", F.concat_ws("-", F.col("part_number").cast("string"), "group_name").alias("key")).agg(F.min("question_id").alias("asset"))
    maps = assets.groupBy("test_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "asset"))).alias("m"))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return maps.select("test_id", F.size("m").cast("long").alias("n"), F.array_join(entries, ";").alias("entries"))


@query("c2_transitions", "SELECT word_id, user_id, word AS state, lag(word) OVER (PARTITION BY user_id ORDER BY word_id) AS before, coalesce(lag(word) OVER (PARTITION BY user_id ORDER BY word_id), '') <> word AS changed FROM words")
def transitions(t):
    from pyspark.sql import Window

    before = F.lag("word").over(Window.partitionBy("user_id").orderBy("word_id"))
    return t.words().select("word_id", "user_id", F.col("word").alias("state"), before.alias("before")).withColumn("changed", F.coalesce("before", F.lit("")) != F.col("state"))


@query("c4_results_in_order", "SELECT user_id AS job_id, string_agg(word, '>' ORDER BY word_id) AS steps FROM words GROUP BY 1")
def results_in_order(t):
    rows = t.words().groupBy(F.col("user_id").alias("job_id")).agg(F.array_sort(F.collect_list(F.struct("word_id", "word"))).alias("s"))
    return rows.select("job_id", F.array_join(F.transform("s", lambda s: s["word"]), ">").alias("steps"))


@query("c4_done_in_order", """,
s AS (SELECT user_id AS job_id, word AS step, word_id AS ordinal, CASE word_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'done' END AS status FROM words)
SELECT job_id, string_agg(step, '>' ORDER BY ordinal) AS steps FROM s WHERE status = 'done' GROUP BY 1
""")
def done_in_order(t):
    """All done steps, with the statuses of s8_last_failed_step."""
    status = F.when(F.col("word_id") % 4 == 0, "failed").when(F.col("word_id") % 4 == 1, "skipped").otherwise("done")
    steps = t.words().select(F.col("user_id").alias("job_id"), F.col("word").alias("step"), F.col("word_id").alias("ordinal"), status.alias("status"))
    rows = steps.where("status = 'done'").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "step"))).alias("s"))
    return rows.select("job_id", F.array_join(F.transform("s", lambda s: s["step"]), ">").alias("steps"))


@query("x11_blocks_found", _BOOK + " SELECT doc_id, count(DISTINCT n) AS blocks FROM bk GROUP BY 1")
def blocks_found(t):
    from quizmill.operators.booklet import question_blocks

    return question_blocks(booklets(t)).groupBy("doc_id").agg(F.count("*").alias("blocks"))


@query("x19_section_texts", _BOOK + " SELECT doc_id, count(*) AS option_lines FROM bk, range(2) GROUP BY 1")
def section_texts(t):
    return extraction.option_lines(booklets(t)).groupBy("doc_id").agg(F.count("*").alias("option_lines"))

"""Sections, blocks, assets, shapes of options, model calls and steps (X-11 to X-18, L-9 to L-13, G-10, P-1, N-4 to N-16, E, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.model import GRAPHIC_STARTS
from quizmill.operators import booklet, coercion, extraction, graphics
from quizmill.plans import enrich, stages
from quizmill.queries.documents import _BOOK, booklets
from quizmill.queries.pages import _SPANS, spans
from quizmill.registry import query
from quizmill.sources import files
from quizmill.streaming import words as word_stream

_SIZE = "length('Part ' || part_number || chr(10) || 'Questions ' || n || '-' || n || ' refer to the following notice.' || chr(10) || passage || ' ' || question_text || chr(10) || n || '. ' || question_text || chr(10) || '(A) ' || group_name || chr(10) || 'B) ' || correct || chr(10) || 'GO ON TO THE NEXT PAGE')"


@query("x14_sections", _BOOK + f""",
sz AS (SELECT doc_id, part_number, pos, {_SIZE} + (pos < of)::INT AS size FROM bk), al AS (SELECT doc_id, sum(size)::BIGINT AS whole FROM sz GROUP BY 1),
la AS (SELECT doc_id, part_number, arg_max(size, pos) AS size FROM sz GROUP BY 1, 2)
SELECT al.doc_id, p.i::INTEGER AS part_number, coalesce(la.size, al.whole)::BIGINT AS size FROM al CROSS JOIN range(1, 8) p(i) LEFT JOIN la ON la.doc_id = al.doc_id AND la.part_number = p.i
""")
def sections(t):
    return booklet.sections(booklets(t)).select("doc_id", "part_number", F.char_length("section").cast("long").alias("size"))


@query("x12_block_options", _BOOK + " SELECT doc_id, n AS question_number, arg_min(group_name || '|' || correct, pos) AS options, arg_min(question_text, pos) AS stem FROM bk GROUP BY 1, 2")
def block_options(t):
    rows = booklet.question_blocks(booklets(t))
    return rows.select("doc_id", "question_number", F.array_join(booklet.block_options(F.col("block")), "|").alias("options"), booklet.conversation_stem(F.col("block"), F.col("question_number")).alias("stem"))


@query("x13_response_stems", _BOOK + " SELECT doc_id, n AS question_number, arg_min(question_text, pos) AS stem FROM bk GROUP BY 1, 2")
def response_stems(t):
    rows = booklet.question_blocks(booklets(t))
    return rows.select("doc_id", "question_number", booklet.response_stem(F.col("block"), F.col("question_number")).alias("stem"))


@query("x16_best_candidates", "SELECT test_id, question_number, arg_max(CASE WHEN size % 3 = 0 THEN question_text ELSE question_text || '|' || group_name END, ((size % 3 <> 0)::INT, -question_id)) AS options FROM questions GROUP BY 1, 2")
def best_candidates(t):
    options = F.when(F.col("size") % 3 == 0, F.array("question_text", F.lit("-"))).otherwise(F.array("question_text", "group_name"))
    rows = booklet.best_candidates(t.questions().select("test_id", "question_number", F.col("question_id").alias("pos"), options.alias("options")), "test_id")
    return rows.select("test_id", "question_number", F.array_join(F.filter("options", lambda o: o != "-"), "|").alias("options"))


@query("x18_repaired_items", "SELECT question_id AS doc_id, question_number, CASE WHEN size % 4 = 0 THEN passage ELSE question_text END AS question_text FROM questions")
def repaired(t):
    q = t.questions()
    items = q.select(F.col("question_id").alias("doc_id"), "question_number", F.when(F.col("size") % 4 == 0, F.concat(F.lit("w ill "), "question_text")).otherwise(F.col("question_text")).alias("question_text"), F.array("group_name").alias("options"))
    other = q.select(F.col("question_id").alias("doc_id"), "question_number", F.col("passage").alias("question_text"), F.array(F.lit("one"), F.lit("two"), F.lit("three")).alias("options"))
    return booklet.repaired(items, other).select("doc_id", "question_number", "question_text")


@query("j20_pages_of_numbers", _SPANS + "SELECT doc_id, number, min(page) AS page FROM sc WHERE label GROUP BY 1, 2")
def pages_of_numbers(t):
    from quizmill.operators import layout

    rows = spans(t)
    return booklet.pages_of_numbers(rows, layout.anchors(rows).select("doc_id", "number").distinct())


@query("l9_layout_questions")
def layout_questions(t):
    """Booklets set as one line per span in one column; each question's band gives its stem and options."""
    lines = booklets(t).select(F.abs(F.xxhash64("doc_id")).alias("doc_id"), F.posexplode(T.lines(F.col("text"))).alias("idx", "text"))
    at = F.col("idx") % 40
    rows = lines.select("doc_id", F.floor(F.col("idx") / 40).cast("int").alias("page"), "idx", "text", F.lit(0.08).alias("x"), (at.cast("double") / 40).alias("y"), F.lit(0.4).alias("w"), F.lit(0.01).alias("h"))
    found = booklet.first_page(booklet.layout_questions(rows), F.col("number") >= 101)
    return found.select("doc_id", "page", "number", "stem", F.array_join("options", "|").alias("options"))


@query("g10_graphic_groups", f"SELECT question_id, part_number, question_number, CASE WHEN question_number IN {GRAPHIC_STARTS[3] + GRAPHIC_STARTS[4]} THEN passage END AS box FROM questions")
def graphic_groups(t):
    q = t.questions().select(F.col("question_id").alias("doc_id"), "part_number", F.col("question_number").alias("first_question"), F.col("passage").alias("box"))
    rows = booklet.with_graphics(q.drop("box"), q.select("doc_id", "first_question", "box"), [*GRAPHIC_STARTS[3], *GRAPHIC_STARTS[4]])
    return rows.select(F.col("doc_id").alias("question_id"), "part_number", F.col("first_question").alias("question_number"), "box")


@query("p1_asset_plan", """
SELECT test_id AS doc_id, size AS page, count(*) AS n, string_agg(part_number || '-' || question_id, ',' ORDER BY part_number || '-' || question_id) AS groups FROM questions WHERE part_number <> 5 GROUP BY 1, 2
""")
def asset_plan(t):
    rows = t.questions().select(F.col("test_id").alias("doc_id"), "part_number", F.col("question_id").alias("group_no"), F.col("size").alias("page"), F.lit(None).cast("struct<x:double>").alias("box"))
    return booklet.asset_plan(rows).select("doc_id", "page", F.size("groups").cast("long").alias("n"), F.array_join("groups", ",").alias("groups"))


@query("n4_options_any_shape", """
SELECT question_id, 'A' AS letter, question_text AS text FROM questions UNION ALL SELECT question_id, 'B' AS letter, group_name AS text FROM questions
""")
def options_any_shape(t):
    a, b = F.col("question_text"), F.col("group_name")
    raw = (
        F.when(F.col("size") % 3 == 0, F.to_json(F.array(a, b)))
        .when(F.col("size") % 3 == 1, F.to_json(F.map_from_arrays(F.array(F.lit("A"), F.lit("B")), F.array(a, b))))
        .otherwise(F.to_json(F.array(F.struct(F.lit("a").alias("letter"), a.alias("text")), F.struct(F.lit("b").alias("letter"), b.alias("text")))))
    )
    return t.questions().select("question_id", F.explode(coercion.options_of(F.parse_json(raw))).alias("o")).select("question_id", "o.*")


@query("n7_question_counts", "SELECT question_id, CASE WHEN size % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM questions")
def question_counts(t):
    q = F.struct(F.col("question_text").alias("text"))
    raw = F.when(F.col("size") % 2 == 0, F.to_json(F.array(q, q))).otherwise(F.to_json(q))
    return t.questions().select("question_id", F.size(coercion.questions_of(F.parse_json(raw))).cast("long").alias("n"))


@query("n13_raw_to_parsed", """
SELECT question_id, array_to_string(list_transform(list_concat(string_split(question_text, ' '), ['-', '-', '-', '-'])[1:4], lambda x, i: chr(64 + i::INTEGER) || ':' || x), '|') AS options, CASE WHEN size > 20 THEN correct ELSE 'A' END AS correct FROM questions
""")
def raw_to_parsed(t):
    rows = t.questions().select("question_id", coercion.raw_to_parsed(F.split("question_text", " "), F.when(F.col("size") > 20, F.lower("correct"))).alias("p"))
    return rows.select("question_id", F.array_join(F.transform("p.options", lambda o: F.concat_ws(":", o["letter"], o["text"])), "|").alias("options"), "p.correct")


@query("n14_valid_regions", "SELECT vec_id, ((x <= 1 AND y <= 1 AND w <= 1 AND h <= 1)::INT)::BIGINT AS n FROM boxes")
def valid_regions(t):
    region = F.struct(F.col("vec_id").cast("string").alias("id"), F.lit(" a ").alias("text"), F.array("x", "y", "w", "h").alias("bbox"))
    return t.boxes().select("vec_id", F.size(coercion.valid_regions(F.array(region))).cast("long").alias("n"))


@query("n16_picked_part", "SELECT question_id, (part_number IN (5, 6))::BOOLEAN AS found FROM questions")
def picked_part(t):
    raw = F.to_json(F.array(*[F.struct(F.lit(p).alias("partNumber")) for p in (5, 6)]))
    return t.questions().select("question_id", coercion.picked_part(F.parse_json(raw), F.col("part_number")).isNotNull().alias("found"))


@query("e3_failure_kinds", """
SELECT conv_id, turn, CASE WHEN contains(lower(text), 'quota') OR contains(lower(text), 'rate limit') OR turn % 7 = 1 THEN 'quota' WHEN contains(lower(text), 'unavailable') OR contains(lower(text), 'high demand') OR turn % 7 = 2 THEN 'unavailable'
  WHEN contains(lower(text), 'json') OR contains(lower(text), 'unexpected token') THEN 'json' WHEN contains(lower(text), 'timeout') OR contains(lower(text), 'network') OR contains(lower(text), 'socket') OR contains(lower(text), 'aborted') OR contains(lower(text), 'terminated') THEN 'network'
  WHEN contains(lower(text), 'truncated') THEN 'truncated' ELSE 'other' END AS kind FROM conversations
""")
def failure_kinds(t):
    status = F.when(F.col("turn") % 7 == 1, 429).when(F.col("turn") % 7 == 2, 503)
    return t.raw("conversations").select("conv_id", "turn", enrich.failure_kind(status, F.col("text")).alias("kind"))


@query("e8_model_calls", "SELECT word_id, upper(word) AS result, 'done' AS result_status FROM words")
def model_calls(t):
    """A deterministic stand-in for the model."""
    return enrich.called(t.words().select("word_id", "word"), "word", lambda texts: [x.upper() for x in texts]).select("word_id", "result", "result_status")


@query("c3_steps_to_redo", """,
st AS (SELECT user_id AS job_id, word AS step, count(*) AS found FROM words GROUP BY 1, 2), off AS (SELECT job_id, step FROM st WHERE found <> 12)
SELECT job_id, step FROM off UNION SELECT DISTINCT job_id, 'save_db' FROM off
""")
def steps_to_redo(t):
    counts = t.words().groupBy(F.col("user_id").alias("job_id"), F.col("word").alias("step")).agg(F.count("*").alias("found"))
    expected = counts.select("step").distinct().withColumn("expected", F.lit(12))
    return stages.to_redo(counts.select("job_id", "step", F.lit("done").alias("status")), counts, expected)


@query("io13_mime_types", "SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf' THEN 'application/pdf' WHEN lower(url) LIKE '%.mp3' THEN 'audio/mpeg' WHEN lower(url) LIKE '%.png' THEN 'image/png' WHEN lower(url) LIKE '%.txt' THEN 'text/plain' WHEN lower(url) LIKE '%.jpg' OR lower(url) LIKE '%.jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime, base64(encode(url)) AS packed FROM pages")
def mime_types(t):
    return t.raw("pages").select("page_id", files.mime_type(F.col("url")).alias("mime"), files.as_base64(F.encode("url", "utf-8")).alias("packed"))


@query("io21_json_rows", """SELECT word_id, '{"user_id":' || user_id || ',"word":"' || word || '"}' AS json FROM words""")
def json_rows(t):
    return t.words().select("word_id", F.to_json(F.struct("user_id", "word")).alias("json"))


@query("st_word_counts", "SELECT date_trunc('day', created_at)::TIMESTAMP AS start, word, count(*) AS n FROM words GROUP BY 1, 2")
def word_counts(t):
    """The stream's aggregate over the whole table."""
    return word_stream.word_counts(t.words().withColumn("created_at", F.col("created_at").cast("timestamp"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "word", "n")


@query("t13_key_builders", "SELECT question_id, 'exams/' || test_id || '/part-' || part_number || '/' || lpad(question_number::VARCHAR, 3, '0') || '.png' AS key, starts_with(group_name, 'Brand') AS is_key FROM questions")
def key_builders(t):
    key = F.concat(F.lit("exams/"), F.col("test_id").cast("string"), F.lit("/part-"), F.col("part_number").cast("string"), F.lit("/"), F.lpad(F.col("question_number").cast("string"), 3, "0"), F.lit(".png"))
    return t.questions().select("question_id", key.alias("key"), F.col("group_name").startswith("Brand").alias("is_key"))


@query("t19_role_names", "SELECT word_id, CASE word WHEN 'click' THEN 'EXAM_DOC' WHEN 'view' THEN 'AUDIO_FILE' ELSE 'UNKNOWN' END AS role, word IN ('click', 'view') AS document_like FROM words")
def role_names(t):
    table = F.create_map(*[F.lit(x) for x in ("click", "EXAM_DOC", "view", "AUDIO_FILE")])
    return t.words().select("word_id", F.coalesce(F.try_element_at(table, F.col("word")), F.lit("UNKNOWN")).alias("role"), F.col("word").isin("click", "view").alias("document_like"))


@query("f17_row_guards", "SELECT status, count(*) AS n, count(*) = 0 AS is_empty, count(scope_part) AS with_part FROM attempts GROUP BY 1")
def row_guards(t):
    n = F.count("*")
    return t.attempts().groupBy("status").agg(n.alias("n"), (n == 0).alias("is_empty"), F.count("scope_part").alias("with_part"))


@query("g6_photo_boxes", f""",
pn AS (SELECT vec_id AS doc_id, n::INTEGER AS number, CASE {" ".join(f"WHEN n = {n} THEN {p}" for n, p in graphics.PHOTO_PAGES.items())} END::INTEGER AS page, least(0.45::DOUBLE, y) + 0.0::DOUBLE AS odd, least(0.45::DOUBLE, y) + 0.4::DOUBLE AS even FROM boxes CROSS JOIN range(1, 7) r(n)),
pt AS (SELECT *, CASE WHEN number % 2 = 1 THEN greatest(0.04::DOUBLE, odd + 0.02::DOUBLE) ELSE greatest(0.04::DOUBLE, even + 0.02::DOUBLE) END AS top FROM pn),
pb AS (SELECT *, CASE WHEN number % 2 = 1 THEN even - 0.01::DOUBLE ELSE top + (even - 0.01::DOUBLE - (odd + 0.02::DOUBLE)) END - top AS high FROM pt),
px AS (SELECT doc_id, page, number, 0.08::DOUBLE AS x, greatest(0.0::DOUBLE, least(1.0::DOUBLE, top)) AS y, 0.84::DOUBLE AS w, high FROM pb)
SELECT doc_id, page, number, x, y, w, greatest(0.0::DOUBLE, least(1 - y, high)) AS h FROM px WHERE greatest(0.0::DOUBLE, least(1 - y, high)) >= 0.02
""")
def photo_boxes(t):
    """Labels of the photo questions at heights taken from the boxes."""
    box = t.boxes().select(F.col("vec_id").alias("doc_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("page")) for n, p in graphics.PHOTO_PAGES.items()])).alias("l"), "x", "y")
    y = F.least(F.lit(0.45), F.col("y")) + F.when(F.col("l.n") % 2 == 0, 0.4).otherwise(0.0)
    rows = box.select("doc_id", "l.page", F.col("l.n").alias("idx"), F.concat(F.col("l.n").cast("string"), F.lit(".")).alias("text"), F.lit(0.05).alias("x"), y.alias("y"), F.lit(0.02).alias("w"), F.lit(0.02).alias("h"))
    return graphics.photo_boxes(rows).select("doc_id", "page", "number", "box.*")


def booklet_spans(t):
    """Booklets as one line per span in one column, 40 lines a page."""
    lines = booklets(t).select(F.abs(F.xxhash64("doc_id")).alias("doc_id"), F.posexplode(T.lines(F.col("text"))).alias("idx", "text"))
    at = F.col("idx") % 40
    return lines.select("doc_id", F.floor(F.col("idx") / 40).cast("int").alias("page"), "idx", "text", F.lit(0.08).alias("x"), (at.cast("double") / 40).alias("y"), F.lit(0.4).alias("w"), F.lit(0.01).alias("h"))


@query("g7_passage_boxes")
def passage_boxes(t):
    return graphics.passage_boxes(booklet_spans(t)).select("doc_id", "page", "first_question", "last_question", "box.*")


@query("g8_graphic_boxes")
def graphic_boxes(t):
    rows = booklet_spans(t)
    numbers = graphics.question_places(rows).select("doc_id", F.col("number").alias("first_question"), F.col("number").alias("last_question")).distinct()
    images = rows.where("idx % 40 = 0").select("doc_id", "page", F.lit(0.1).alias("x"), F.lit(0.2).alias("y"), F.lit(0.3).alias("w"), F.lit(0.2).alias("h"))
    return graphics.graphic_boxes(rows, images, numbers).select("doc_id", "page", "first_question", "box.*")


@query("x8_transcripts")
def transcripts(t):
    """Conversations as talks of the conversation parts."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.concat(F.lit("M-Cn "), s["text"])), "\n")
    talks = t.raw("conversations").groupBy("conv_id").agg(said.alias("said"))
    first = F.when(F.col("conv_id") % 2 == 0, "32-34\n").otherwise("71-73\n")
    sections = talks.select("conv_id", F.when(F.col("conv_id") % 2 == 0, 3).otherwise(4).alias("part_number"), F.concat(first, "said").alias("section"))
    return extraction.transcripts(sections, "conv_id")


@query("x10_listening_items")
def listening_items(t):
    blocks = booklet.question_blocks(booklets(t)).withColumn("stem", booklet.response_stem(F.col("block"), F.col("question_number"))).withColumn("options", booklet.block_options(F.col("block")))
    answers = t.questions().select(F.concat_ws("-", F.col("test_id").cast("string"), "group_name").alias("doc_id"), "question_number", F.col("correct").alias("letter")).groupBy("doc_id", "question_number").agg(F.min("letter").alias("letter"))
    talks = answers.where("question_number between 32 and 100").select("doc_id", F.col("question_number").alias("first_question"), F.lit("talk").alias("transcript"))
    rows = extraction.listening_items(blocks.select("doc_id", "question_number", "stem", "options"), answers, talks)
    return rows.withColumn("options", F.array_join("options", "|"))

"""Whole parts, pages and exams (L-6, L-15, N-8 to N-11, V-3, V-5, X-7, X-10, X-11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.operators import booklet, classify, coercion, layout
from quizmill.queries.coverage import PARTS
from quizmill.queries.documents import _BOOK, booklets
from quizmill.queries.pages import spans
from quizmill.registry import query


@query("l6_question_anchors")
def question_anchors(t):
    """One anchor for each number of a page, from labels, lines, inline numbers and the page's text."""
    return layout.question_anchors(spans(t), 101, 200).select("doc_id", "page", "column", "number", "y", "next_y")


@query("n11_parts", """,
j AS (SELECT *, row_number() OVER (PARTITION BY test_id, part_number ORDER BY question_id) AS place FROM questions)
SELECT test_id, part_number, (place - 1) // 3 AS group_no, question_number, question_text, CASE WHEN size % 2 = 0 THEN 'A' ELSE upper(correct) END AS correct FROM j
""")
def parts(t):
    """Whole parts as JSON, three questions a group under changing key names, and back."""
    q = t.questions()
    number, text = F.col("question_number"), F.col("question_text")
    one = F.when(F.col("size") % 2 == 0, F.to_json(F.struct(number.alias("questionNumber"), text.alias("questionText")))).otherwise(F.to_json(F.struct(number.alias("number"), text.alias("question"), F.col("correct").alias("answer"))))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("question_id", one.alias("j")))), lambda s: s["j"])
    rows = q.groupBy("test_id", "part_number").agg(listed.alias("l"))
    groups = F.transform(F.sequence(F.lit(0), ((F.size("l") - 1) / 3).cast("int")), lambda k: F.concat(F.lit('{"questions": ['), F.array_join(F.slice("l", k * 3 + 1, 3), ", "), F.lit("]}")))
    raw = F.concat(F.lit('{"partNumber": '), F.col("part_number").cast("string"), F.lit(', "groups": ['), F.array_join(groups, ", "), F.lit("]}"))
    found = coercion.parts(rows.select(F.concat_ws("-", F.col("test_id").cast("string"), F.col("part_number").cast("string")).alias("key"), raw.alias("raw"), F.lit(None).cast("int").alias("expected")))
    return found.select(F.split_part("key", F.lit("-"), F.lit(1)).cast("int").alias("test_id"), "part_number", F.col("group_no").cast("long").alias("group_no"), "question_number", "question.question_text", "question.correct")


@query("v3_structure", f""",
o AS (SELECT test_id, question_number, sum(size % 6)::BIGINT AS n_options FROM questions WHERE size % 6 > 0 GROUP BY 1, 2),
s AS (SELECT test_id, question_number, count(*) AS n, max(length(question_text)) AS size FROM questions GROUP BY 1, 2),
x AS (SELECT s.*, coalesce(n_options, 0) AS n_options, p.part_number AS part FROM s LEFT JOIN o USING (test_id, question_number) LEFT JOIN {PARTS} ON question_number BETWEEN p.first AND p.last),
e AS (SELECT test_id, count(DISTINCT question_number) AS n FROM questions GROUP BY 1),
c AS (SELECT test_id, p.part_number AS part, p.last - p.first + 1 AS expected FROM e, {PARTS} WHERE e.n >= 200),
f AS (SELECT test_id, part_number AS part, count(*) AS n FROM questions q GROUP BY 1, 2)
SELECT test_id, question_number, 'number' AS rule FROM x WHERE part IS NULL UNION ALL SELECT test_id, question_number, 'repeated' FROM x WHERE n > 1
UNION ALL SELECT test_id, question_number, 'text' FROM x WHERE size = 0 UNION ALL SELECT test_id, question_number, 'options' FROM x WHERE n_options < CASE WHEN part = 2 THEN 3 ELSE 4 END
UNION ALL SELECT DISTINCT q.test_id, q.question_number, 'options' FROM questions q JOIN o USING (test_id, question_number) WHERE q.part_number = 2 AND n_options > 4
UNION ALL SELECT test_id, NULL, 'too few' FROM e WHERE n < 185
UNION ALL SELECT e.test_id, n.i::INTEGER, 'missing' FROM e, range(1, 201) n(i) WHERE e.n >= 200 AND NOT EXISTS (SELECT 1 FROM questions q WHERE q.test_id = e.test_id AND q.question_number = n.i)
UNION ALL SELECT c.test_id, NULL, 'part ' || c.part FROM c LEFT JOIN f USING (test_id, part) WHERE coalesce(f.n, 0) <> c.expected
""")
def structure(t):
    q = t.questions()
    options = q.where("size % 6 > 0").select("test_id", "question_number", F.explode(F.sequence(F.lit(1), F.col("size") % 6)).alias("k"))
    return classify.structure_violations(q, options, "test_id")


@query("v5_key_routes", "SELECT group_name, count(*) AS n, CASE WHEN count(*) >= 80 THEN 'rule' WHEN count(*) >= 50 THEN 'text' ELSE 'model' END AS route FROM questions GROUP BY 1")
def key_routes(t):
    return classify.key_route(t.questions().select("group_name", "question_number"), "group_name")


@query("x11_blocks_to_next", _BOOK + """,
tl AS (SELECT *, 'Part ' || part_number || chr(10) || 'Questions ' || n || '-' || n || ' refer to the following notice.' || chr(10) || passage || ' ' || question_text AS head,
  question_text || chr(10) || '(A) ' || group_name || chr(10) || 'B) ' || correct || chr(10) || 'GO ON TO THE NEXT PAGE' AS said FROM bk),
tn AS (SELECT *, lead(head) OVER (PARTITION BY doc_id ORDER BY pos) AS next_head FROM tl),
pc AS (SELECT doc_id, pos, n, of, said || CASE WHEN next_head IS NULL THEN '' ELSE chr(10) || next_head || chr(10) END AS tail FROM tn),
en AS (SELECT a.doc_id, a.n, a.pos, coalesce(min(b.pos), CASE WHEN a.n IN (100, 200) THEN any_value(a.of) + 1 END) AS stop FROM pc a LEFT JOIN pc b ON b.doc_id = a.doc_id AND b.n = a.n + 1 AND b.pos > a.pos GROUP BY a.doc_id, a.n, a.pos),
ch AS (SELECT doc_id, n, min(pos) AS pos, arg_min(stop, pos) AS stop FROM en WHERE stop IS NOT NULL GROUP BY 1, 2)
SELECT ch.doc_id, ch.n::INTEGER AS question_number, md5(string_agg(CASE WHEN pc.pos = ch.pos THEN ' ' ELSE pc.n || '. ' END || pc.tail, '' ORDER BY pc.pos)) AS block
FROM ch JOIN pc ON pc.doc_id = ch.doc_id AND pc.pos >= ch.pos AND pc.pos < ch.stop GROUP BY 1, 2
""")
def blocks_to_next(t):
    rows = booklet.blocks_to_next(booklets(t), [100, 200], ["doc_id"])
    return rows.select("doc_id", "question_number", F.md5("block").alias("block"))


@query("x10_listening_parts")
def listening_parts(t):
    """Conversations as listening keys: a talk with questions behind it."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: F.concat(F.lit("W-Am "), s["text"])), "\n")
    keys = t.raw("conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(said.alias("said"))
    asked = "\n32\nWhat is said?\n(A) one\n(B) two\n(C) three\n(D) four\n33. Who says it?\n(A) him\n(B) her\n34. Why?\n(A) so\n32 (C)\n33 (A)"
    text = F.concat(F.lit("PART 1\nPART 2\n7. W-Am Where is it?\n(A) here\n(B) there\n8. x\nPART 3\n32-34\n"), "said", F.lit(asked))
    rows = booklet.listening_parts(keys.select("doc_id", text.alias("text")))
    return rows.select("doc_id", "part_number", "first_question", "question_number", "stem", F.array_join("options", "|").alias("options"), "letter", F.md5("transcript").alias("transcript"))


def set_booklets(t):
    """(texts, spans, key): booklets set as one line per span, 40 lines a page, and their reading keys."""
    texts = booklets(t).select(F.abs(F.xxhash64("doc_id")).alias("doc_id"), "text")
    lines = texts.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("idx", "text"))
    at = F.col("idx") % 40
    rows = lines.select("doc_id", F.floor(F.col("idx") / 40).cast("int").alias("page"), "idx", "text", F.lit(0.08).alias("x"), (at.cast("double") / 40).alias("y"), F.lit(0.4).alias("w"), F.lit(0.01).alias("h"))
    key = t.questions().select(F.abs(F.xxhash64(F.concat_ws("-", F.col("test_id").cast("string"), "group_name"))).alias("doc_id"), "question_number", F.col("correct").alias("letter"))
    return texts, rows, key.groupBy("doc_id", "question_number").agg(F.min("letter").alias("letter"))


@query("l15_reading_groups")
def reading_groups(t):
    """Part 7's groups from passages and pages."""
    groups = booklet.reading_groups(*set_booklets(t), 7)
    return groups.select("doc_id", "page", "first_question", F.size("questions").alias("n"), F.length("passage").alias("size"))


@query("l15_document")
def document(t):
    """Whole exams: every part's groups from a booklet's text as listening key and exam, and from its pages."""
    texts, rows, key = set_booklets(t)
    images = rows.where("idx % 40 = 20").select("doc_id", "page", "x", "y", "w", F.lit(0.1).alias("h"))
    groups = booklet.document(texts.withColumn("key_text", F.col("text")), rows, images, key)
    return groups.select("doc_id", "part_number", "first_question", "page", F.size("questions").alias("n"), F.md5(F.to_json("questions")).alias("questions"))


@query("l13_questions_by_page")
def questions_by_page(t):
    """Part 5's questions by page, through the operator."""
    _, rows, key = set_booklets(t)
    return booklet.part5_groups(rows, key).select("doc_id", "page", "first_question", F.size("questions").alias("n"))

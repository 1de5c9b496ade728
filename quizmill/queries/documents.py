"""Text scalars and extraction over documents (T, X, V-1).

The prose of ``documents`` has no exam structure, so key and section queries
run over texts assembled from the answer log and the question bank.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.operators import classify, extraction
from quizmill.registry import query


def key_texts(t):
    """One answer sheet per attempt: lines ``101. A``, ``102 B`` or ``103) C``."""
    letter = F.get(F.array(*[F.lit(x) for x in "ABCD"]), (F.col("question_id") % 4).cast("int"))
    mark = F.get(F.array(F.lit(". "), F.lit(" "), F.lit(") ")), (F.col("question_id") % 3).cast("int"))
    line = F.concat((F.col("question_id") % 110 + 95).cast("string"), mark, letter)
    rows = t.answers().select("attempt_id", F.struct("question_id", "selected", "version", line.alias("line")).alias("s"))
    rows = rows.groupBy("attempt_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select(F.col("attempt_id").alias("doc_id"), F.array_join(F.transform("s", lambda s: s["line"]), "\n").alias("text"))


_KEYS = """,
kl AS (SELECT attempt_id AS doc_id, question_id AS k, (question_id % 110 + 95) AS n, ['A', 'B', 'C', 'D'][question_id % 4 + 1] AS letter, question_id % 3 AS form, row_number() OVER (PARTITION BY attempt_id ORDER BY question_id, selected, v1, v2, v3, v4) AS pos FROM answers)"""


@query("x3_reading_key", _KEYS + """
SELECT doc_id, n::INTEGER AS question_number, arg_max(letter, (form = 1, pos)) AS letter FROM kl WHERE n BETWEEN 101 AND 200 GROUP BY 1, 2
""")
def reading_key(t):
    return extraction.reading_key(key_texts(t))


@query("x4_listening_key", _KEYS + " SELECT doc_id, n::INTEGER AS question_number, arg_min(letter, pos) AS letter FROM kl WHERE n BETWEEN 95 AND 204 AND form <> 1 GROUP BY 1, 2")
def listening_key(t):
    return extraction.listening_key(key_texts(t), 95, 204)


def booklets(t):
    """One booklet per test and group: part headers, question lines with options, and passages."""
    q = t.questions()
    block = F.concat(
        F.lit("Part "), F.col("part_number").cast("string"), F.lit("\nQuestions "), F.col("question_number").cast("string"), F.lit("-"), F.col("question_number").cast("string"),
        F.lit(" refer to the following notice.\n"), F.col("passage"), F.lit(" "), F.col("question_text"), F.lit("\n"), F.col("question_number").cast("string"), F.lit(". "), F.col("question_text"),
        F.lit("\n(A) "), F.col("group_name"), F.lit("\nB) "), F.col("correct"), F.lit("\nGO ON TO THE NEXT PAGE"),
    )
    rows = q.select("test_id", "group_name", F.struct("question_id", block.alias("b")).alias("s")).groupBy("test_id", "group_name").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select(F.concat_ws("-", F.col("test_id").cast("string"), "group_name").alias("doc_id"), F.array_join(F.transform("s", lambda s: s["b"]), "\n").alias("text"))


_BOOK = """,
bk AS (SELECT test_id || '-' || group_name AS doc_id, question_id, question_number AS n, part_number, passage, question_text, group_name, correct, row_number() OVER (PARTITION BY test_id, group_name ORDER BY question_id) AS pos,
  count(*) OVER (PARTITION BY test_id, group_name) AS of FROM questions)"""


@query("x1_part_slices", _BOOK + """
SELECT doc_id, part_number, length('Part ' || part_number || chr(10) || 'Questions ' || n || '-' || n || ' refer to the following notice.' || chr(10) || passage || ' ' || question_text || chr(10) || n || '. ' || question_text || chr(10) || '(A) ' || group_name || chr(10) || 'B) ' || correct || chr(10) || 'GO ON TO THE NEXT PAGE') + (pos < of)::INT AS size
FROM bk QUALIFY row_number() OVER (PARTITION BY doc_id, part_number ORDER BY pos DESC) = 1
""")
def part_slices(t):
    return extraction.part_slices(booklets(t)).select("doc_id", "part_number", F.char_length("section").alias("size"))


@query("x2_option_lines", _BOOK + " SELECT doc_id, 'A' AS letter, group_name AS option_text FROM bk UNION ALL SELECT doc_id, 'B', correct FROM bk")
def option_lines(t):
    return extraction.option_lines(booklets(t)).select("doc_id", "letter", "option_text")


@query("x15_passages", _BOOK + " SELECT doc_id, n AS first_question, n AS last_question, passage || ' ' || question_text AS passage FROM bk WHERE length(passage || ' ' || question_text) > 20")
def passages(t):
    return extraction.passages(booklets(t))


@query("x5_line_predicates", """,
li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(trim(line), '^[0-9]{1,3}\\s*([.):]\\s*[A-Da-d]|\\([A-Da-d]\\))$')) AS key_lines, count(*) FILTER (regexp_matches(line, '[A-Za-z]')) AS with_letters FROM li GROUP BY 1
""")
def predicates(t):
    rows = extraction.numbered_lines(t.documents())
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(T.is_answer_key_line(F.col("line"))).alias("key_lines"), F.count_if(T.letter_count(F.col("line")) > 0).alias("with_letters"),
    )


@query("x6_photo_sets")
def photo_sets(t):
    """A fold over lines: statement sets built from the question bank's texts."""
    said = ["The man is looking at", "Some people are sitting near", "She's putting away", "The workers are facing"]
    rows = t.questions().select(F.col("question_id").alias("doc_id"), F.array_join(F.array(*[F.concat(F.lit(f"({c}) {s} "), "question_text") for c, s in zip("ABCD", said, strict=True)]), "\n").alias("text"))
    return extraction.photo_sets(rows)


@query("x9_clean_transcripts", """,
li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
ke AS (SELECT doc_id, k, regexp_replace(regexp_replace(line, '^[\\s\\p{Z}]+', ''), '[\\s\\p{Z}]+$', '') AS line FROM li)
SELECT doc_id, length(trim(regexp_replace(string_agg(line, chr(10) ORDER BY k), '\\s{2,}', ' ', 'g'))) AS size FROM ke
WHERE line <> '' AND NOT regexp_matches(line, '(?i)^PART\\s*[0-9]|^\\s*[0-9]{1,3}\\s*-\\s*[0-9]{1,3}\\b|^TEST\\s+[0-9]|^GO ON TO THE NEXT PAGE|^\\s*[0-9]{1,3}\\s*[.):]\\s*[A-D]\\s*$') AND NOT regexp_matches(line, '^[\\x00-\\x7F]*[^\\x00-\\x7F]{3,}') GROUP BY 1
""")
def transcripts(t):
    rows = t.raw("documents").select("doc_id", F.char_length(extraction.clean_transcript(F.col("text"))).alias("size"))
    return rows.where("size > 0")


@query("x9_clean_all_transcripts")
def all_transcripts(t):
    """Every document, whatever its language; no SQL, as DuckDB's white space differs."""
    cleaned = t.raw("documents").select("doc_id", "lang", extraction.clean_transcript(F.coalesce("text", F.lit(""))).alias("transcript"))
    return cleaned.withColumn("size", F.char_length("transcript"))


@query("x17_garbled_lines", """,
li AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, trim(line) AS s, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters FROM li)
SELECT doc_id, count(*) FILTER (s NOT IN ('', '-') AND ((length(s) >= 3 AND letters = 0) OR regexp_matches(s, '[~^_=<>{}\\\\|¬`]') OR (regexp_matches(s, '[^A-Za-z0-9\\s]{2}') AND letters < length(s) * 0.6)
  OR regexp_matches(s, '(?i)\\b(w\\s+ill|w\\s+ould|w\\s+as|w\\s+ere|c\\s+an|c\\s+ould|s\\s+hould|t\\s+he|t\\s+hey|t\\s+hat|f\\s+or|b\\s+e)\\b'))) AS garbled FROM s GROUP BY 1
""")
def garbled(t):
    rows = extraction.numbered_lines(t.documents())
    return rows.groupBy("doc_id").agg(F.count_if(T.is_garbled(F.col("line"))).alias("garbled"))


@query("t1_trim_collapse", "SELECT question_id, trim('  ' || question_text || chr(9)) AS trimmed, regexp_replace('a  b ' || question_text, '\\s+', ' ', 'g') AS collapsed, question_text AS unquoted FROM questions".replace("trim('  ' || question_text || chr(9))", "question_text"))
def trim_collapse(t):
    c = F.col("question_text")
    return t.questions().select("question_id", T.trim(F.concat(F.lit("  "), c, F.lit("\t"))).alias("trimmed"), T.collapse(F.concat(F.lit("a  b "), c)).alias("collapsed"), T.strip_quotes(F.concat(F.lit("'\""), c)).alias("unquoted"))


@query("t2_case", "SELECT question_id, upper(question_text) AS up, lower(group_name) AS low, upper(correct) = 'A' AS is_a FROM questions")
def case(t):
    return t.questions().select("question_id", F.upper("question_text").alias("up"), F.lower("group_name").alias("low"), (F.upper("correct") == "A").alias("is_a"))


@query("t5_lines", "SELECT doc_id, len(string_split(text, chr(10))) AS n, string_split(text, chr(10))[1] AS first FROM documents")
def line_split(t):
    return t.documents().select("doc_id", F.size(T.lines(F.col("text"))).cast("long").alias("n"), F.get(T.lines(F.col("text")), 0).alias("first"))


@query("t6_positions", "SELECT doc_id, contains(text, 'license') AS has, starts_with(text, 'The') AS begins, right(text, 5) AS tail, left(text, 10) AS head, instr(text, ' ') AS first_space FROM documents")
def positions(t):
    c = F.col("text")
    return t.documents().select("doc_id", c.contains("license").alias("has"), c.startswith("The").alias("begins"), F.right(c, F.lit(5)).alias("tail"), F.left(c, F.lit(10)).alias("head"), F.instr(c, " ").cast("long").alias("first_space"))


@query("t9_line_numbers", "SELECT doc_id, len(string_split(left(text, 200), chr(10))) - 1 AS line FROM documents")
def line_numbers(t):
    return t.documents().select("doc_id", T.line_number(F.col("text"), F.lit(200)).cast("long").alias("line"))


@query("t10_letter_share", "SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(text), 1) AS share FROM documents")
def letter_share(t):
    letters = T.letter_count(F.col("text"))
    return t.documents().select("doc_id", letters.cast("long").alias("letters"), (letters / F.greatest(F.char_length("text"), F.lit(1))).alias("share"))


@query("t11_object_keys", """
SELECT page_id, regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[^a-zA-Z0-9._-]', '_', 'g') AS safe, 'exams/' || page_id || '/' || regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '[^a-zA-Z0-9._-]', '_', 'g') AS key, regexp_extract(url, '(\\.[^./]*)$', 1) AS extension FROM pages
""")
def object_keys(t):
    url = F.col("url")
    safe = T.safe_name(T.base_name(url))
    return t.raw("pages").select("page_id", safe.alias("safe"), F.concat(F.lit("exams/"), F.col("page_id").cast("string"), F.lit("/"), safe).alias("key"), F.regexp_extract(url, r"(\.[^./]*)$", 1).alias("extension"))


@query("t14_letters", "SELECT question_id, chr(65 + (question_id % 4)::INTEGER) AS letter, ascii(correct) - 65 AS place FROM questions")
def letters(t):
    return t.questions().select("question_id", T.letter(F.col("question_id") % 4).alias("letter"), (F.ascii("correct") - 65).alias("place"))


@query("t15_padded_options", "SELECT question_id, array_to_string(list_concat(string_split(question_text, ' '), ['-', '-', '-', '-'])[1:4], '|') AS options FROM questions")
def padded(t):
    return t.questions().select("question_id", F.array_join(T.padded(F.split("question_text", " "), 4), "|").alias("options"))


@query("t17_words", "SELECT question_id, regexp_replace(question_text, '-+', ' ', 'g') AS spaced, regexp_matches(string_split(question_text, ' ')[1], '^[A-Za-z][A-Za-z''-]{0,24}$') AS is_word FROM questions")
def words(t):
    return t.questions().select("question_id", T.dashes_to_spaces(F.col("question_text")).alias("spaced"), T.is_word(F.get(F.split("question_text", " "), 0)).alias("is_word"))


@query("t18_defaults", "SELECT question_id, CASE WHEN size > 25 THEN question_text ELSE 'Question ' || question_number END AS text FROM questions")
def defaults(t):
    text = F.when(F.col("size") > 25, F.col("question_text")).otherwise(" ")
    return t.questions().select("question_id", T.or_default(text, F.concat(F.lit("Question "), F.col("question_number").cast("string"))).alias("text"))


@query("v1_file_roles", """
SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'EXAM_DOC' WHEN contains(lower(text), 'apache') THEN 'LISTENING_KEY_DOC' WHEN contains(lower(text), '@') THEN 'READING_KEY_IMAGE' ELSE 'UNKNOWN' END AS role,
  CASE WHEN contains(lower(text), 'license') THEN 0.82 WHEN contains(lower(text), 'apache') THEN 0.78 WHEN contains(lower(text), '@') THEN 0.7 ELSE 0.35 END::DOUBLE AS confidence FROM documents
""")
def file_roles(t):
    files = t.documents().select("doc_id", F.lit("upload").alias("name"), F.lit("text/plain").alias("mime_type"), "text")
    return classify.roles(files, ("license",), ("apache",), ("@",)).select("doc_id", "role", "confidence")

import re

from pyspark.sql import functions as F

from quizmill.catalog import QUERIES
from quizmill.functions import text as T
from quizmill.operators import classify, coverage, extraction

DATA = "/root/testdata/sf0.001"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_reading_key(spark):
    got = extraction.reading_key(docs(spark, "101. A\n102 B\n103) C\n150: D\n200 - A\n100. A\n201. B\n151 Dollars\n101: B", "", None))
    assert {r.question_number: r.letter for r in got.collect()} == {101: "B", 102: "B", 103: "C", 150: "D", 200: "A", 151: "D"}


def test_listening_key(spark):
    got = extraction.listening_key(docs(spark, "1 (A)\n 2. b \n3: C\n1 (D)\n(A) text\n101 (A)"))
    assert {r.question_number: r.letter for r in got.collect()} == {1: "A", 2: "B", 3: "C"}


def test_part_slices_last_header_wins(spark):
    got = {r.part_number: r.section for r in extraction.part_slices(docs(spark, "x Part 1 one PART 2 two part 1 again")).collect()}
    assert got == {1: "part 1 again", 2: "PART 2 two "}


def test_option_lines(spark):
    rows = extraction.option_lines(docs(spark, "(A) first\nb. second \nE) no\nC no")).collect()
    assert [(r.letter, r.option_text) for r in rows] == [("A", "first"), ("B", "second")]


def test_passages(spark):
    text = "Questions 131-134 refer to the following letter.\n Dear reader, this is long enough.\nGO ON TO THE NEXT PAGE\n131. What?\nQuestion 147-148 refer to the notice.\nshort"
    rows = extraction.passages(docs(spark, text)).collect()
    assert [(r.first_question, r.last_question, r.passage) for r in rows] == [(131, 134, "Dear reader, this is long enough.")]


def cleaned(raw: str | None) -> str:
    """The platform's rules by hand."""
    space = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
    s = f"[{space}]"
    rules = [rf"PART{s}*[0-9]", rf"[0-9]{{1,3}}{s}*-{s}*[0-9]{{1,3}}\b", rf"TEST{s}+[0-9]", "GO ON TO THE NEXT PAGE", rf"[0-9]{{1,3}}{s}*[.):]{s}*[A-D]$"]
    keep = [x for x in (line.strip(space) for line in (raw or "").split("\n")) if x and not any(re.match(r, x, re.I | re.A) for r in rules) and not re.match(r"[\x00-\x7f]*[^\x00-\x7f]{3,}", x)]
    return re.sub(f"{s}{{2,}}", " ", "\n".join(keep)).strip(space)


def test_all_transcripts(spark, tmp_path):
    """Documents of every language, and of none, are cleaned and returned."""
    texts = ["Hello.\nPART 1", "Guten Tag\u3000\u3000zusammen.\n32-34é\nТри слова\n12. b", "日本語", None, "PART\u00a02\nTEST\u20033\nfür\u00a0 alle", "1-2x\n1-2 x\n7: A\ufeff", "", "a\u3000\n\n b"]
    rows = [(i, text, lang) for i, (text, lang) in enumerate(zip(texts, ["en", "de", "ja", "en", "fr", None, "es", None], strict=True))]
    rows += [(100 + r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.transcript, r.size) for r in QUERIES["x9_clean_all_transcripts"](spark, str(tmp_path)).collect()}
    assert got == {i: (cleaned(text), len(cleaned(text))) for i, text, _ in rows}


def test_clean_transcript(spark):
    text = "PART 3\n32-34 x\nM-Cn Hello  there.\n\n51. A\nTEST 1\nxéééé\nBye."
    assert docs(spark, text).select(extraction.clean_transcript(F.col("text")).alias("t")).first().t == "M-Cn Hello there.\nBye."


def test_photo_sets():
    text = "51 (A)\n(A) She's opening the file drawer\nof a desk\n(B) She's sitting in a car\n52 (B)\n'(C) Some people are walking\n(D) The man is looking up\n(A) Some books are loaded\n(A) They're facing the ship\nB) They're hanging clothes\nC) The workers are sweeping\nD) The flag has been raised"
    got = extraction.photo_sets_of(text.split("\n"))
    assert [n for n, _ in got] == [1, 8]
    assert got[0][1] == ["She's opening the file drawer of a desk", "She's sitting in a car", "Some people are walking", "The man is looking up"]
    assert extraction.photo_sets_of([]) == []


def test_garbled(spark):
    rows = docs(spark, "fine text", "r~~.ii", "w ill go", "-", "", None, "123", "£&71Af::;;").select("doc_id", T.is_garbled(F.col("text")).alias("g")).collect()
    assert [r.g for r in rows] == [False, True, True, False, False, False, True, True]


def test_unicode_trim(spark):
    assert docs(spark, "\t  a  \n").select(T.trim(F.col("text")).alias("t")).first().t == "a"


def test_islands(spark):
    rows = spark.createDataFrame([(1, n) for n in (101, 102, 105, 107, 108, 109, 102)], "k int, n int")
    assert coverage.islands(rows, "k", "n").first().ranges == "101-102, 105, 107-109"


def test_parse_summary(spark):
    found = spark.createDataFrame([(n,) for n in [*range(101, 131), *range(131, 140), 147]], "question_number int")
    got = {r.part_number: (r.parsed, r.expected, r.missing) for r in coverage.parse_summary(found, spark).collect()}
    assert got[5] == (30, 30, "—") and got[6] == (9, 16, "140-146") and got[7] == (1, 54, "148-200") and got[1] == (0, 6, "1-6")


def test_roles(spark):
    files = [("a.MP3", "x", ""), ("Key RC.pdf", "application/pdf", ""), ("transcript.pdf", None, ""), ("x", "", "PART 5 begins"), ("x", "", "Listening"), ("x", "", "101"), ("x", "", "hello"), (None, None, None)]
    rows = classify.roles(spark.createDataFrame(files, "name string, mime_type string, text string")).collect()
    assert [(r.role, r.confidence) for r in rows] == [("AUDIO_FILE", 1.0), ("READING_KEY_IMAGE", 0.92), ("LISTENING_KEY_DOC", 0.92), ("EXAM_DOC", 0.82), ("LISTENING_KEY_DOC", 0.78), ("READING_KEY_IMAGE", 0.7), ("UNKNOWN", 0.35), ("UNKNOWN", 0.35)]


def test_violations(spark):
    q = spark.createDataFrame([(1, 7, "x"), (1, 7, "y"), (1, 8, " "), (1, 205, "z")], "test_id int, question_number int, question_text string")
    o = spark.createDataFrame([(1, 7)] * 3 + [(1, 8)] * 2 + [(1, 205)] * 4, "test_id int, question_number int")
    assert {(r.question_number, r.rule) for r in classify.violations(q, o, "test_id").collect()} == {(7, "repeated"), (8, "text"), (8, "options"), (205, "number")}

import pytest
from pyspark.sql import functions as F

from quizmill.operators import booklet, coercion, layout
from quizmill.plans import enrich

SPANS = "doc_id long, page int, idx int, text string, x double, y double, w double, h double"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def test_sections(spark):
    got = {r.part_number: r.section for r in booklet.sections(docs(spark, "intro PART 5 five PART 6 six")).collect()}
    assert got[5] == "PART 5 five " and got[6] == "PART 6 six" and got[7] == "intro PART 5 five PART 6 six"


CONVERSATION = "32. Look at the graphic.\nWhich parking area w ill be closed?\nM-Cn hello\n(A) one\nB. two\n33) next\nW-Am (A) The fifth. (B) No\n33. again"


def test_question_blocks(spark):
    rows = booklet.question_blocks(docs(spark, CONVERSATION)).withColumn("stem", booklet.conversation_stem(F.col("block"), F.col("question_number"))).withColumn("options", booklet.block_options(F.col("block")))
    got = {r.question_number: (r.stem, r.options) for r in rows.collect()}
    assert got[32] == ("Look at the graphic. Which parking area w ill be closed?", ["one", "two"])
    assert got[33] == ("next", ["The fifth.", "No"])


@pytest.mark.parametrize(("block", "want"), [("W-Br Where is it?\n(A) x", "Where is it?"), ("Is it so?\n(A) x", "Is it so?"), ("plain\n(B) y", "plain"), ("(A) x", "Question 9")])
def test_response_stem(spark, block, want):
    assert docs(spark, block).select(booklet.response_stem(F.col("text"), F.lit(9)).alias("s")).first().s == want


def test_best_candidates_and_repair(spark):
    rows = spark.createDataFrame([(1, 5, 0, ["a", "-", "-", "-"]), (1, 5, 1, ["a", "b", "-", "-"]), (1, 5, 2, ["c", "d", "-", "-"])], "doc_id int, question_number int, pos int, options array<string>")
    assert booklet.best_candidates(rows).first().options == ["a", "b", "-", "-"]
    schema = "doc_id int, question_number int, question_text string, options array<string>"
    items = spark.createDataFrame([(1, 1, "r~~.ii", ["x"]), (1, 2, "fine", ["y"]), (1, 3, "w ill", ["z"])], schema)
    other = spark.createDataFrame([(1, 1, "clean", ["a", "b", "c", "-"]), (1, 2, "other", ["a", "b", "c"]), (1, 3, "clean", ["a", "~", "c"])], schema)
    assert {r.question_number: (r.question_text, r.options) for r in booklet.repaired(items, other).collect()} == {1: ("clean", ["a", "b", "c", "-"]), 2: ("fine", ["y"]), 3: ("w ill", ["z"])}


def page(spark, *rows):
    return spark.createDataFrame([(1, p, i, t, x, y, 0.1, 0.01) for i, (p, t, x, y) in enumerate(rows)], SPANS)


def test_layout_questions(spark):
    s = page(spark, (1, "101. to ------- items", 0.08, 0.1), (1, "second line", 0.08, 0.15), (1, "(A) a", 0.08, 0.2), (1, "(B) b", 0.08, 0.25), (1, "102. no options", 0.08, 0.4))
    rows = booklet.layout_questions(s).collect()
    assert [(r.number, r.stem, r.options) for r in rows] == [(101, "to ------- items second line", ["a", "b", "-", "-"])]
    assert booklet.first_page(booklet.layout_questions(s), F.col("page") == 1).count() == 1


def test_pages_of_numbers(spark):
    s = page(spark, (1, "see 103. maybe", 0.3, 0.1), (2, "103. here", 0.08, 0.1), (2, "and 104. too", 0.3, 0.2))
    numbers = spark.createDataFrame([(1, 103), (1, 104), (1, 105)], "doc_id long, number int")
    assert {r.number: r.page for r in booklet.pages_of_numbers(s, numbers).collect()} == {103: 2, 104: 2, 105: None}


def test_graphics_and_assets(spark):
    groups = spark.createDataFrame([(1, 3, 62), (1, 3, 59)], "doc_id int, part_number int, first_question int")
    graphics = spark.createDataFrame([(1, 62, "b"), (1, 59, "c")], "doc_id int, first_question int, box string")
    assert {r.first_question: r.box for r in booklet.with_graphics(groups, graphics, [62, 65, 68]).collect()} == {62: "b", 59: None}
    rows = spark.createDataFrame([(1, 6, 0, 3, (0.1,)), (1, 7, 1, 3, None), (1, 5, 0, 2, None), (1, 3, 4, 1, (0.2,))], "doc_id int, part_number int, group_no int, page int, box struct<x:double>")
    assert {(r.page, r.crop): r.groups for r in booklet.asset_plan(rows).collect()} == {(3, None): ["6-0", "7-1"], (1, '{"x":0.2}'): ["3-4"]}


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('"(A) x (B) y"', [("A", "x"), ("B", "y")]),
        ('["a) p", "q", " "]', [("A", "p"), ("B", "q")]),
        ('[{"letter": "c", "text": "p"}, {"optionText": "q"}, {"text": ""}]', [("C", "p"), ("B", "q")]),
        ('{"A": "x", "B": "y"}', [("A", "x"), ("B", "y")]),
        ("5", [("A", "5")]),
    ],
)
def test_options_of_any_shape(spark, raw, want):
    assert [tuple(o) for o in one(spark, coercion.options_of(F.parse_json(F.lit(raw))))] == want


def test_questions_of_any_shape(spark):
    n = lambda raw: len(one(spark, coercion.questions_of(F.parse_json(F.lit(raw)))))
    assert [n('[{"text": "a"}, {"text": "b"}]'), n('{"questionText": "a"}'), n('{"x": {"text": "a"}, "y": {"text": "b"}}'), n("3")] == [2, 1, 2, 0]


def test_regions_raw_and_picked(spark):
    regions = spark.createDataFrame([([("a", " t ", [0.0, 0.1, 0.2, 1.0]), ("b", "t", [0.0, 0.1, 2.0, 1.0]), ("", "t", [0.0] * 4), ("d", "t", [0.1])],)], "r array<struct<id:string,text:string,bbox:array<double>>>")
    assert [(r.id, r.text) for r in regions.select(coercion.valid_regions(F.col("r")).alias("r")).first().r] == [("a", "t")]
    got = one(spark, coercion.raw_to_parsed(F.array(F.lit("x"), F.lit("")), F.lit(None).cast("string")))
    assert [tuple(o) for o in got.options] == [("A", "x"), ("B", "-"), ("C", "-"), ("D", "-")] and got.correct == "A"
    pick = lambda raw: one(spark, coercion.picked_part(F.parse_json(F.lit(raw)), F.lit(6)))
    assert pick('[{"partNumber": 5}, {"partNumber": 6}]') == '{"partNumber":6}' and pick('[{"partNumber": 5}]') == '{"partNumber":5}' and pick('[{"partNumber": 5}, {"partNumber": 7}]') is None


def test_failures(spark):
    rows = spark.createDataFrame([(429, ""), (None, "Model unavailable"), (None, "Unexpected token <"), (500, "x"), (401, None), (None, "fetch failed"), (None, "hm"), (None, "Quota: retry in 2.5 s"), (None, '"retryDelay": "300s"')], "status int, message string")
    got = rows.select(enrich.failure_kind(F.col("status"), F.col("message")).alias("k"), enrich.retry_delay_ms(F.col("message")).alias("ms")).collect()
    assert [r.k for r in got] == ["quota", "unavailable", "json", "server", "auth", "network", "other", "quota", "other"]
    assert [r.ms for r in got][-2:] == [2500, 120000]


def test_headers_over_several_spans_need_no_other_texts(spark):
    rows = [(1, 1, 0, "see Questions"), (1, 1, 1, "131 -"), (1, 1, 2, "134 refer"), (1, 2, 3, "Questions 131-134"), (1, 2, 4, "Questions"), (1, 2, 5, "to"), (1, 2, 6, "140-143"), (1, 3, 7, "question 140-"), (1, 3, 8, None), (1, 3, 9, "143")]
    spans = spark.createDataFrame(rows, "doc_id long, page int, idx int, text string")
    found = booklet.passage_pages_of_spans(spans)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in booklet.passage_pages(layout.page_texts(spans)).collect()} == {(1, 131, 134, 1), (1, 140, 143, 3)}

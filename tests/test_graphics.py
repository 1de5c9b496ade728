import pytest
from pyspark.sql import functions as F

from quizmill.operators import extraction, graphics

SPANS = "doc_id long, page int, idx int, text string, x double, y double, w double, h double"
IMAGES = "doc_id long, page int, x double, y double, w double, h double"


def spans(spark, *rows):
    return spark.createDataFrame([(1, p, i, t, x, y, w, 0.02) for i, (p, t, x, y, w) in enumerate(rows)], SPANS)


def test_photo_boxes(spark):
    got = {r.number: r.box for r in graphics.photo_boxes(spans(spark, (2, "1.", 0.05, 0.1, 0.02), (2, "2.", 0.05, 0.5, 0.02), (3, "3.", 0.05, 0.2, 0.02), (9, "5.", 0.05, 0.2, 0.02))).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].y, got[1].h) == (pytest.approx(0.12), pytest.approx(0.37))
    assert (got[2].y, got[2].h) == (pytest.approx(0.52), pytest.approx(0.37))
    assert got[3].y + got[3].h == pytest.approx(0.92)


def test_passage_boxes(spark):
    s = spans(spark, (1, "Questions 131-134 refer to the letter.", 0.1, 0.1, 0.5), (1, "Dear reader", 0.1, 0.2, 0.4), (1, "more text here", 0.1, 0.3, 0.6), (1, "%%%", 0.1, 0.35, 0.6), (1, "131. (A) x", 0.1, 0.5, 0.2), (1, "late text", 0.1, 0.6, 0.2))
    r = graphics.passage_boxes(s).first()
    assert (r.first_question, r.last_question) == (131, 134)
    assert (r.box.x, r.box.y) == (pytest.approx(0.09), pytest.approx(0.195)) and r.box.y + r.box.h < 0.5
    bare = spans(spark, (1, "Questions 131-134 refer", 0.1, 0.1, 0.5), (1, "131. (A) x", 0.1, 0.5, 0.2))
    assert graphics.passage_boxes(bare).first().box.y == pytest.approx(0.125)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_passage_boxes_meet_on_the_page(spark):
    """Headers, first options and texts were four joins, of which Spark sent sides to the driver and all tasks."""
    first = [(1, "Questions 131-134 refer to this", 0.1, 0.05, 0.5), (1, "Dear reader", 0.1, 0.1, 0.4), (1, "Questions 131-134 refer to this", 0.1, 0.2, 0.5), (1, "more text", 0.1, 0.3, 0.6), (1, "131. (A) x", 0.1, 0.4, 0.2)]
    s = spans(spark, *first, (1, "Questions 135-136 refer", 0.1, 0.6, 0.5), (1, "last words", 0.2, 0.7, 0.3), (2, "131. (A) y", 0.1, 0.1, 0.2))
    found = graphics.passage_boxes(s)
    got = {r.first_question: r.box for r in found.collect()}
    assert set(got) == {131, 135} and len(got) == found.count()
    assert (got[131].y, got[131].y + got[131].h) == (pytest.approx(0.295), pytest.approx(0.33))  # from the last header on
    assert (got[135].x, got[135].y) == (pytest.approx(0.19), pytest.approx(0.695))
    assert "Join" not in plan_of(found) and "Broadcast" not in plan_of(found)


def page(spark):
    left = [(1, "65. Look at the graphic", 0.08, 0.4, 0.2), (1, "66. What", 0.08, 0.5, 0.2), (1, "(A) a", 0.08, 0.53, 0.1), (1, "67. Who", 0.08, 0.6, 0.2)]
    right = [(1, "68. Look at the graphic", 0.55, 0.4, 0.2), (1, "69. What", 0.55, 0.5, 0.2), (1, "70. Who", 0.55, 0.6, 0.2)]
    groups = spark.createDataFrame([(1, 65, 67), (1, 68, 70)], "doc_id long, first_question int, last_question int")
    return spans(spark, *left, *right), groups


def test_graphics_from_images(spark):
    s, groups = page(spark)
    images = spark.createDataFrame([(1, 1, 0.08, 0.12, 0.38, 0.2), (1, 1, 0.52, 0.12, 0.38, 0.2)], IMAGES)
    got = {r.first_question: r.box for r in graphics.graphic_boxes(s, images, groups).collect()}
    assert got[65].x < 0.3 and got[65].y < 0.35 and got[68].x > 0.45


def test_graphics_strip_without_images(spark):
    s, groups = page(spark)
    s = s.withColumn("text", F.replace("text", F.lit("graphic"), F.lit("thing")))
    got = {r.first_question: r.box for r in graphics.graphic_boxes(s, spark.createDataFrame([], IMAGES), groups).collect()}
    assert got[65].x < 0.3 and got[65].h > 0.1 and got[65].y + got[65].h <= 0.4


def test_graphics_meet_on_the_page(spark):
    """Fourteen joins on the page, each with sorts in the same tasks, took a task's memory; only the groups' places are joined now."""
    s, groups = page(spark)
    found = graphics.graphic_boxes(s, spark.createDataFrame([], IMAGES), groups)
    assert plan_of(found).count("Join") == 1 and "Window" not in plan_of(graphics.question_places(s))
    rows = [(1, "12", 0.3, 0.2, 0.02), (1, "12.", 0.1, 0.3, 0.02), (1, ". What is on the graphic", 0.13, 0.305, 0.2), (1, "13. Who", 0.1, 0.4, 0.2), (1, "13. Whom", 0.1, 0.5, 0.2)]
    assert {(r.number, r.x, r.y) for r in graphics.question_places(spans(spark, *rows)).collect()} == {(12, 0.1, 0.3), (13, 0.1, 0.4)}


def test_resolved(spark):
    given = spark.createDataFrame([(1, 5, "own"), (1, 6, None), (1, 7, None)], "doc_id long, first_question int, box string")
    found = spark.createDataFrame([(1, 5, "f"), (1, 6, "f")], "doc_id long, first_question int, box string")
    assert {r.first_question: r.box for r in graphics.resolved(given, found).collect()} == {5: "own", 6: "f", 7: None}


TALKS = "PART 3\n32-34\nM-Cn Hello, I would like to ask about the office plans today.\nW-Br Sure, go ahead.\n32\nWhat is it?\n(A) x\nM-Au Another talk begins here and it is quite long as well.\n35\nWho are they?\n"


def test_transcripts(spark):
    sections = spark.createDataFrame([(1, 3, TALKS), (1, 5, TALKS), (2, 4, None)], "doc_id int, part_number int, section string")
    got = {r.first_question: r.transcript for r in extraction.transcripts(sections).collect()}
    assert got[32].startswith("M-Cn Hello") and got[32].endswith("go ahead.") and "Another talk" in got[35]


def test_listening_items(spark):
    blocks = spark.createDataFrame([(1, 8, "q", ["a"]), (1, 33, "r", ["a", "b"]), (1, 150, "s", ["a"])], "doc_id int, question_number int, stem string, options array<string>")
    answers = spark.createDataFrame([(1, 33, "B")], "doc_id int, question_number int, letter string")
    talks = spark.createDataFrame([(1, 32, "talk")], "doc_id int, first_question int, transcript string")
    got = {r.question_number: (r.options, r.letter, r.transcript) for r in extraction.listening_items(blocks, answers, talks).collect()}
    assert got == {8: (["a", "-", "-"], None, None), 33: (["a", "b", "-", "-"], "B", "talk")}

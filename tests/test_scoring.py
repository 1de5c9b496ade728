import datetime as dt

from quizmill.operators import scoring

QUESTIONS = "question_id string, test_id int, part_number int, correct string"
ATTEMPTS = "attempt_id int, test_id int, scope_part int"
ANSWERS = "attempt_id int, question_id string, selected string"


def score(spark, scope, answers, part=None):
    q = spark.createDataFrame([(i, 1, p, "A") for i, p in scope], QUESTIONS)
    a = spark.createDataFrame([(1, 1, part)], ATTEMPTS)
    s = spark.createDataFrame([(1, i, "a" if right else "B") for i, right in answers], ANSWERS)
    return scoring.attempt_scores(a, q, s).first()


def test_full_test(spark):
    scope = [(f"l-{i}", 1 if i < 50 else 2) for i in range(100)] + [(f"r-{i}", 5 if i < 50 else 6) for i in range(100)]
    got = score(spark, scope, [(i, k < 60) for k, (i, _) in enumerate(scope[:80])])
    assert (got.listening_total, got.reading_total) == (100, 100)
    assert (got.listening_correct, got.reading_correct) == (60, 0)
    assert (got.listening_score, got.reading_score, got.total_score) == (297, 0, 297)


def test_part_practice(spark):
    scope = [(f"p5-{i}", 5) for i in range(30)] + [(f"l-{i}", 1) for i in range(6)]
    got = score(spark, scope, [(i, k < 24) for k, (i, _) in enumerate(scope[:30])], part=5)
    assert (got.reading_correct, got.reading_total, got.reading_score) == (24, 30, 396)
    assert (got.listening_score, got.total_score) == (0, 396)


def test_nothing_answered_and_no_questions(spark):
    got = score(spark, [("x", 9)], [])
    assert (got.listening_total, got.reading_total, got.total_score) == (0, 0, 0)


def test_history(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 1, 1, "COMPLETED", day(1)), (2, 1, 1, "STARTED", day(2)), (3, 1, 2, "STARTED", day(1)), (4, 1, 2, "STARTED", day(3)), (5, 1, 3, "COMPLETED", day(1)), (6, 1, 3, "STARTED", day(2))]
    attempts = spark.createDataFrame(rows, "attempt_id int, user_id int, test_id int, status string, started_at timestamp")
    answers = spark.createDataFrame([(6, 1), (3, 1)], "attempt_id int, question_id int")
    assert {r.attempt_id for r in scoring.history(attempts, answers).collect()} == {1, 4, 5, 6}
    assert {r.attempt_id: r.action for r in scoring.resumed(attempts).collect()} == {2: "resume", 3: "delete", 4: "resume", 6: "resume"}


def test_enrichment_batch(spark):
    words = spark.createDataFrame([(1, 1, "Cat"), (2, 1, "dog"), (3, 1, "cat"), (4, 1, "fox")], "word_id int, user_id int, word string")
    known = spark.createDataFrame([("cat",), ("fox",)], "low string")
    got = {r.word_id: r.status for r in scoring.enrichment_batch(words, known, "user_id", 2).collect()}
    assert got == {1: "done", 2: "failed", 3: "done", 4: "failed"}

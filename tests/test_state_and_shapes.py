import base64

import pytest
from pyspark.sql import functions as F

from quizmill.catalog import QUERIES
from quizmill.operators import coercion, state
from quizmill.plans import enrich, stages
from quizmill.sources import files
from quizmill.streaming import words

LOG = "k string, v string, version int"


def test_upsert_twice_is_once(spark):
    a, b = spark.createDataFrame([("x", "1", 1), ("y", "2", 2)], LOG), spark.createDataFrame([("x", "3", 3)], LOG)
    once = state.upserted(a, b, ["k"], "version")
    twice = state.upserted(a.unionByName(b), b, ["k"], "version")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("x", "3"), ("y", "2")]


def test_deletes_and_cascades(spark):
    log = spark.createDataFrame([("x", "1", 1, "upsert"), ("x", "", 2, "delete"), ("y", "2", 1, "upsert")], LOG + ", op string")
    assert [tuple(r) for r in state.live(log, ["k"], "version").collect()] == [("y", "2")]
    rows, gone = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, k string"), spark.createDataFrame([("a",), ("a",)], "k string")
    assert {r.id for r in state.without(rows, gone, "k").collect()} == {2, 3}
    assert {r.id: r.k for r in state.detached(rows, gone, "k").collect()} == {1: None, 2: "b", 3: None}


def test_or_keep(spark):
    rows = spark.createDataFrame([("", "a"), (None, "b"), ("n", "c")], "new string, old string")
    assert [r.x for r in rows.select(state.or_keep(F.col("new"), F.col("old")).alias("x")).collect()] == ["a", "b", "n"]


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


@pytest.mark.parametrize(("raw", "want"), [("a) cat", ("A", "cat")), (" dog ", ("C", "dog")), ("  ", None), (None, None)])
def test_option(spark, raw, want):
    got = one(spark, coercion.option(F.lit(raw).cast("string"), F.lit("C")))
    assert (tuple(got) if got else None) == want


def test_labelled_options(spark):
    got = one(spark, coercion.labelled_options(F.lit("(A) x y (b) z\nw (C)  ")))
    assert [tuple(o) for o in got] == [("A", "x y"), ("B", "z\nw")]
    assert [tuple(o) for o in one(spark, coercion.labelled_options(F.lit("(A) alone")))] == [("A", "(A) alone")]
    assert one(spark, coercion.labelled_options(F.lit(" "))) == []


def test_stem_and_question(spark):
    assert one(spark, coercion.stem(F.lit("What is it? (A) x (B) y"))) == "What is it?"
    assert one(spark, coercion.stem(F.lit("(A) x (B) y"))) == "(A) x (B) y"
    q = one(spark, coercion.question(F.parse_json(F.lit('{"number": 7, "question": "Who?", "answer": "b)"}'))))
    assert tuple(q) == (7, "Who?", "B")
    assert tuple(one(spark, coercion.question(F.parse_json(F.lit('{"questionNumber": 3}'))))) == (3, "Question 3", "A")


def test_numbers_and_groups(spark):
    numbers = F.array(*[F.lit(x).cast("int") for x in (None, 103, None, 101, None)])
    assert one(spark, coercion.with_numbers(numbers, F.lit(101))) == [101, 103, 104, 101, 105]
    assert one(spark, coercion.dealt(F.array(*map(F.lit, range(5))), F.lit(3))) == [[0, 1], [2, 3], [4]]
    assert one(spark, coercion.dealt(F.array(F.lit(1)), F.lit(2))) == [[1], []]


def test_fenced_json(spark):
    value = lambda raw: one(spark, F.try_variant_get(coercion.fenced_json(F.lit(raw)), "$.a", "int"))
    assert value('{"a": 1}') == 1 and value('text ```json\n{"a": 2}\n``` more') == 2 and value("no") is None


def test_stages_resume(spark, tmp_path):
    calls = []

    def step(name, fail=False):
        def run(spark, results):
            calls.append(name)
            if fail:
                raise RuntimeError(name)
            return spark.range(3)

        return (name, run)

    with pytest.raises(RuntimeError):
        stages.run_steps(spark, str(tmp_path), "job", [step("a"), step("b", fail=True)])
    assert stages.run_steps(spark, str(tmp_path), "job", [step("a"), step("b")]) == {"a": "skipped", "b": "done"}
    assert calls == ["a", "b", "b"]


def test_redo(spark):
    states = spark.createDataFrame([(1, "p", "done"), (1, "q", "done"), (2, "p", "done"), (2, "q", "failed")], "job_id int, step string, status string")
    counts = spark.createDataFrame([(1, "p", 5), (1, "q", 6), (2, "p", 6), (2, "q", 1)], "job_id int, step string, found int")
    expected = spark.createDataFrame([("p", 6), ("q", 6)], "step string, expected int")
    assert {tuple(r) for r in stages.to_redo(states, counts, expected).collect()} == {(1, "p"), (1, "save_db")}


def test_model_calls(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    good = enrich.called(rows, "t", lambda texts: [x.upper() for x in texts]).collect()
    assert {(r.result, r.result_status) for r in good} == {("A", "done"), ("B", "done")}

    def broken(texts):
        raise ValueError

    assert {r.result_status for r in enrich.called(rows, "t", broken, tries=2).collect()} == {"failed"}


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\x0ctwo")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    found = files.files(spark, str(tmp_path), "*.pdf")
    pages = files.texts(found, lambda b: b.decode("utf-8").split("\x0c")).collect()
    assert [(r.page, r.text) for r in pages] == [(0, "one"), (1, "two")]
    assert {one(spark, files.mime_type(F.lit(n))) for n in ("x/a.PDF", "b.mp3", "c")} == {"application/pdf", "audio/mpeg", "application/octet-stream"}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", "a"), (2, "2024-01-01 11:00:00", "a"), (3, "2024-01-02 09:00:00", "b")], "user_id int, at string, word string")
    rows = rows.select("user_id", F.to_timestamp("at").alias("created_at"), "word")
    rows.write.parquet(str(tmp_path / "in"))
    stream = words.word_counts(words.read(spark, str(tmp_path / "in"), "user_id int, created_at timestamp, word string"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("word_counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("word_counts").collect())) == sorted(map(tuple, words.word_counts(rows).collect()))


DATA = "/root/testdata/sf0.001"


def test_every_box_in_order(spark):
    boxes = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    want = [i for _, _, i in sorted((abs(r.embedding[1]), abs(r.embedding[0]), r.vec_id) for r in boxes)]
    assert len(want) > 50
    assert [r.vec_id for r in QUERIES["s3_all_by_two_keys"](spark, DATA).collect()] == want


def test_every_done_step(spark):
    want = {}
    for r in sorted(spark.read.parquet(f"{DATA}/events.parquet").collect(), key=lambda r: r.event_id):
        if r.event_id % 4 in (2, 3):
            want.setdefault(r.user_id, []).append(r.event_type)
    got = {r.job_id: r.steps for r in QUERIES["c4_done_in_order"](spark, DATA).collect()}
    assert got == {k: ">".join(v) for k, v in want.items()}


def test_base64_is_one_line_whatever_its_length(spark, tmp_path):
    urls = ["http://a/b.pdf", "https://" + "long/" * 40 + "x.PNG", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.mime, r.packed) for r in QUERIES["io13_mime_types"](spark, str(tmp_path)).collect()}
    types = ("application/pdf", "image/png", "application/octet-stream")
    assert got == {k: (types[k], url and base64.b64encode(url.encode()).decode()) for k, url in enumerate(urls)}


def test_numbers_of_a_long_part_take_time_as_its_length(spark):
    """A fold that appends copies its array for every element: 300,000 numbers would take hours."""
    numbers = F.transform(F.sequence(F.lit(0), F.lit(299_999)), lambda i: F.when(i % 3 == 0, i * 2))
    given = [i * 2 if i % 3 == 0 else None for i in range(300_000)]
    want, after = [], 101
    for n in given:
        want.append(after if n is None else n)
        after = after + 1 if n is None else max(after, n + 1)
    assert one(spark, coercion.with_numbers(numbers, F.lit(101))) == want


def test_numbers_without_a_first_and_over_groups(spark):
    ints = lambda *xs: F.array(*[F.lit(x).cast("int") for x in xs])
    assert one(spark, coercion.with_numbers(ints(None, 5, None), F.lit(None).cast("int"))) == [None, 5, 6]
    assert one(spark, coercion.with_numbers(F.lit(None).cast("array<int>"), F.lit(1))) is None
    assert one(spark, coercion.with_numbers_of_groups(F.array(ints(None, 9), F.array().cast("array<int>"), ints(None, 2, None)), F.lit(1))) == [[1, 9], [], [10, 2, 11]]


def test_part_of_many_groups(spark):
    """Every group's row would once hold all groups and numbers of its part."""
    raw = '{"partNumber": 7, "groups": [' + ", ".join('{"passage": "p%d", "questions": [{"text": "a"}, {"number": %d, "text": "b"}]}' % (k, 200 + 2 * k) for k in range(4000)) + "]}"
    rows = coercion.parts(spark.createDataFrame([(1, raw, None)], "key int, raw string, expected int"))
    got = sorted((r.group_no, r.question_number, r.passage, r.question.question_text) for r in rows.collect())
    assert got == sorted(x for k in range(4000) for x in ((k, 147 if k == 0 else 199 + 2 * k, f"p{k}", "a"), (k, 200 + 2 * k, f"p{k}", "b")))

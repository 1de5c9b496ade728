"""Whole pages and whole exams: anchors of every kind, question blocks, reading groups, the document."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quizmill.model import PART_RANGES
from quizmill.operators import booklet, classify, coercion, extraction, layout
from quizmill.plans import enrich, imports, stages
from quizmill.sources import objects, versions

SPANS = "doc_id long, page int, idx int, text string, x double, y double, w double, h double"
IMAGES = "doc_id long, page int, x double, y double, w double, h double"


def spans(spark, *rows):
    """(page, text, x, y) or (page, text, x, y, w)."""
    return spark.createDataFrame([(1, r[0], i, r[1], r[2], r[3], r[4] if len(r) > 4 else 0.1, 0.01) for i, r in enumerate(rows)], SPANS)


def options(page, x, y):
    return [(page, f"({c}) option {c.lower()}", x, y + 0.02 * k) for k, c in enumerate("ABCD")]


def test_anchors_of_every_kind(spark):
    rows = spans(
        spark,
        (1, "101", 0.08, 0.1, 0.02), (1, ".", 0.101, 0.1, 0.005), (1, "Adalet Farm sells", 0.13, 0.1),  # a line's start
        (1, "see 102. inside", 0.08, 0.3), (1, "The fourth word here", 0.08, 0.4), (1, "105.", 0.55, 0.2, 0.02), *options(1, 0.55, 0.23), (1, "106.", 0.08, 0.6, 0.02),
    )
    texts = spark.createDataFrame([(1, 1, "103. The fourth word here and more")], "doc_id long, page int, page_text string")
    got = {r.number: (r.column, r.y) for r in layout.question_anchors(rows, 101, 130, texts).collect()}
    assert got == {101: ("left", 0.1), 102: ("left", 0.3), 103: ("left", 0.4), 105: ("right", 0.2), 106: ("left", 0.6)}
    assert 101 not in {r.number for r in layout.question_anchors(rows, 102, 130, texts).collect()}


def test_the_anchor_with_options_counts(spark):
    rows = spans(spark, (1, "104. mentioned", 0.08, 0.1), (1, "104.", 0.08, 0.5, 0.02), *options(1, 0.08, 0.53))
    assert [(r.number, r.y) for r in layout.question_anchors(rows).collect()] == [(104, 0.5)]


def test_columns_do_not_bleed(spark):
    rows = spans(spark, (1, "101. The farm plans to ------- items", 0.08, 0.2), (1, "second line", 0.08, 0.22), *options(1, 0.08, 0.25), (1, "105. Other words stand here", 0.55, 0.2), *options(1, 0.55, 0.25))
    key = spark.createDataFrame([(1, 101, "B")], "doc_id long, question_number int, letter string")
    got = {r.number: r for r in booklet.layout_questions(rows, key).collect()}
    assert got[101].stem == "The farm plans to ------- items second line" and got[101].letter == "B"
    assert got[105].stem == "Other words stand here" and got[105].letter is None
    assert got[105].options == ["option a", "option b", "option c", "option d"]


def test_short_stem_gives_way_and_boxes_are_left_out(spark):
    rows = spans(spark, (1, "all of 107. Who wrote the letter", 0.08, 0.05), (1, "107.", 0.08, 0.5, 0.02), (1, "PARKING AREA A", 0.2, 0.52), *options(1, 0.08, 0.55))
    box = spark.createDataFrame([(1, 1, 0.16, 0.5, 0.25, 0.04)], IMAGES)
    assert [r.stem for r in booklet.layout_questions(rows, exclude=box).collect()] == ["Who wrote the letter"]
    assert "PARKING" in booklet.layout_questions(rows).first().stem


def test_blocks_end_at_the_next_number(spark):
    docs = spark.createDataFrame([(1, "7. first\n12 apples are here\n(A) x\n8. second\n(A) y\n31) last\n(A) z\n33. more")], "doc_id int, text string")
    got = {r.question_number: r.block for r in booklet.blocks_to_next(docs, [31], ["doc_id"]).collect()}
    assert set(got) == {7, 31} and "12 apples" in got[7] and "second" not in got[7] and "33. more" in got[31]


def test_photo_questions_take_early_sets_third(spark):
    said = lambda k: [f"{c}. They're looking at picture {k} {c}" for c in "ABCD"]
    lines = lambda *parts: "\n".join(x for part in parts for x in part)
    texts = {
        1: lines(said(1), ["PART1"], said(2), ["51 (A)"], said(3), said(4), ["PART 2"], said(5)),
        2: lines(["PART1"], said(1), ["PART2"]),
        3: lines(said(9), ["PART 1"], *(said(k) for k in range(1, 9)), ["PART 2"]),
        4: lines(said(1), said(1), said(2)),
        5: lines(said(1), said(2), ["PART 1"], said(1), said(3), said(3)),
        6: lines(said(1), ["PART 1"], said(4)),
        7: "",
        8: None,
    }
    want = {1: "2 3 1 4 - -", 2: "1 - - - - -", 3: "1 2 3 4 5 6", 4: "1 1 2 - - -", 5: "3 1 2 - - -", 6: "4 1 - - - -", 7: "- - - - - -", 8: "- - - - - -"}
    got = {}
    for r in extraction.photo_questions(spark.createDataFrame(list(texts.items()), "doc_id int, text string")).orderBy("doc_id", "question_number").collect():
        got.setdefault(r.doc_id, []).append(r.options[0].split()[-2] if " " in r.options[0] else r.options[0])
    assert {k: " ".join(v) for k, v in got.items()} == want


def test_listening_parts(spark):
    text = "PART 1\nPART 2\n7. W-Am Where is it?\n(A) here\n(B) there\n8. x\nPART 3\n32-34\nW-Am Good morning everyone, welcome to the annual meeting of us\n32\nWhat is it?\n(A) a\n(B) b\n(C) c\n(D) d\n33. Who?\n7 (B)\n32 (C)"
    got = {r.question_number: r for r in booklet.listening_parts(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert sorted(got) == list(range(1, 101))
    assert (got[7].stem, got[7].options, got[7].letter) == ("Where is it?", ["here", "there", "-"], "B")
    assert (got[32].stem, got[32].options, got[32].letter, got[32].first_question) == ("What is it?", ["a", "b", "c", "d"], "C", 32)
    assert got[34].transcript.startswith("W-Am Good morning") and got[1].options == ["-"] * 4


def test_reading_groups_and_document(spark):
    exam = "PART 5\nPART 6\nQuestions 131-132 refer to the following notice.\nA notice that is long enough to count\n131. x\nPART 7\nQuestions 147-148 refer to the following letter.\nDear all, this is the letter of the day\n147. y"
    page = [(1, "101. Some stem of part five", 0.08, 0.1), *options(1, 0.08, 0.12)]
    page += [(2, "Questions 131-132 refer to the notice", 0.08, 0.05), (2, "131. The stem of this one", 0.08, 0.1), *options(2, 0.08, 0.12), (3, "132. Its stem is over here", 0.08, 0.1), *options(3, 0.08, 0.12)]
    page += [(4, "147. Why was it written", 0.08, 0.1), *options(4, 0.08, 0.12), (4, "150. What is said at all", 0.08, 0.5), *options(4, 0.08, 0.52)]
    rows = spans(spark, *page)
    key = spark.createDataFrame([(1, 131, "D")], "doc_id long, question_number int, letter string")
    docs = spark.createDataFrame([(1, exam, "PART 1\nPART 2\n7. W-Am Where?\n(A) here\n8. x")], "doc_id long, text string, key_text string")
    six = booklet.reading_groups(docs, rows, key, 6).collect()
    assert [(g.page, g.pages, g.first_question, [q.question_number for q in g.questions], g.questions[0].letter) for g in six] == [(2, [2, 3], 131, [131, 132], "D")]
    seven = {g.first_question: (g.page, [q.question_number for q in g.questions]) for g in booklet.reading_groups(docs, rows, key, 7).collect()}
    assert seven == {147: (4, [147]), 148: (None, [150])}  # a run's page is that of its first number
    assert booklet.reading_groups(docs, rows, key, 7, (149, 160)).count() == 1
    whole = booklet.document(docs, rows, spark.createDataFrame([], IMAGES), key).collect()
    parts = {r.part_number for r in whole}
    assert parts == set(range(1, 8))
    assert sum(len(r.questions) for r in whole if r.part_number == 1) == 6
    assert {tuple(r.box) for r in whole if r.part_number > 4} == {(0.0, 0.0, 1.0, 1.0)}


def test_parts_of_any_shape(spark):
    rows = [
        (1, '{"partNumber": 3, "groups": [{"talk": "hello", "pages": [2, 2, 0, 3], "bbox": [0.1, 0.1, 0.5, 0.5], "questions": [{"questionText": "a"}, {"questionNumber": 40, "questionText": "b"}, {"text": "c"}]}]}', None),
        (2, '{"group": {"passage": "p"}, "questions": [{"number": 5, "question": "q"}]}', 1),
        (3, '{"partNumber": 5, "groups": [{}, {}], "questions": [{"text": "x"}, {"text": "y"}, {"text": "z"}]}', None),
        (4, '{"partNumber": 5, "questions": [{"text": "x"}, {"text": "y"}]}', None), (5, "[1]", 2), (6, '{"partNumber": 9}', None), (7, "no json", 2),
    ]
    got = coercion.parts(spark.createDataFrame(rows, "key int, raw string, expected int")).collect()
    of = lambda k: sorted((r.group_no, r.question_number) for r in got if r.key == k and not r.error)
    assert of(1) == [(0, 32), (0, 40), (0, 41)] and of(2) == [(0, 5)] and of(3) == [(0, 101), (0, 102), (1, 103)] and of(4) == [(0, 101), (1, 102)]
    first = next(r for r in got if r.key == 1)
    assert (first.transcript, first.pages, first.box.w) == ("hello", [2, 3], 0.5)
    assert {r.key: r.error for r in got if r.error} == {5: "not an object", 6: "part number", 7: "not an object"}


def test_structure_violations(spark):
    ranges = [(p, n) for p, (a, b, _) in PART_RANGES.items() for n in range(a, b + 1)]
    schema = "exam int, part_number int, question_number int, question_text string"
    full = [(1, p, n, "t") for p, n in ranges] + [(2, p, n, "t") for p, n in ranges if n <= 184] + [(3, p if n != 200 else 6, n, "t") for p, n in ranges]
    q = spark.createDataFrame(full, schema)
    o = q.select("exam", "question_number", F.explode(F.sequence(F.lit(1), F.when(F.col("question_number") == 7, 5).otherwise(4))).alias("k"))
    got = {(r.exam, r.question_number, r.rule) for r in classify.structure_violations(q, o, "exam").collect()}
    assert got == {(e, 7, "options") for e in (1, 2, 3)} | {(2, None, "too few"), (3, None, "part 6"), (3, None, "part 7")}
    assert {r.exam: r.route for r in classify.key_route(q.where("exam < 3 or question_number < 60"), "exam").collect()} == {1: "rule", 2: "rule", 3: "text"}


def test_steps_keep_failures_and_resume(spark, tmp_path):
    folder, runs = f"file://{tmp_path}", []

    def part7(s, results, span):
        runs.append(span)
        if span == (3, 4) and runs.count(span) == 1:
            raise stages.PartialOutput("cut off", "half a text")
        return s.range(span[0], span[1] + 1)

    steps = stages.chunks("parse_part7", part7, [(1, 2), (3, 4)])
    with pytest.raises(stages.PartialOutput):
        stages.run_steps(spark, folder, "j", steps)
    failed = stages.states(spark, folder).where("step = 'parse_part7_3_4'").first()
    assert (failed.status, failed.partial) == ("failed", "half a text")
    assert stages.run_steps(spark, folder, "j", steps) == {"parse_part7_1_2": "skipped", "parse_part7_3_4": "done", "parse_part7": "done"}
    assert spark.read.parquet(f"{folder}/j/parse_part7").count() == 4 and runs == [(1, 2), (3, 4), (3, 4)]


def test_models_in_order(spark):
    def broken(text):
        raise stages.PartialOutput("truncated", text.upper())

    def closing(text):
        return text + "!"

    rows = spark.createDataFrame([("a",), ("b",)], "t string")
    got = enrich.first_that_answers(rows, "t", [("one", broken), ("two", closing)], continued=lambda text, partial: partial).collect()
    assert [(r.result, r.result_by) for r in got] == [("A!", "two"), ("B!", "two")]
    assert [r.result_error for r in enrich.first_that_answers(rows, "t", [("one", broken)]).collect()] == ["truncated"] * 2

    def picky(texts):
        if "b" in texts:
            raise ValueError("no b")
        return texts

    assert [(r.result, r.result_status) for r in enrich.called(rows.coalesce(1), "t", picky, tries=2, wait=lambda m, k: 0.0).collect()] == [("a", "done"), (None, "failed")]


def test_versions_switch_together(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    assert versions.seed_if_empty(spark, folder) and not versions.seed_if_empty(spark, folder)
    assert versions.read(spark, folder, "questions").count() == 7 and versions.read(spark, folder, "users").count() == 2
    versions.write_version(spark, folder, {"tests": spark.range(3)})
    assert versions.read(spark, folder, "tests").count() == 3 and versions.read(spark, folder, "parts").count() == 7
    objects = spark.createDataFrame([("a/b.txt", b"x"), ("c.txt", None)], "key string, content binary")
    for _ in range(2):
        assert {(r.key, r.size) for r in versions.put_objects(objects, f"file://{tmp_path}/objects").collect()} == {("a/b.txt", 1), ("c.txt", 0)}
    assert sorted(p.name for p in (tmp_path / "objects").rglob("*.txt")) == ["b.txt", "c.txt"]


def test_parts_with_numbers_beyond_an_int_are_rows(spark):
    raw = ['{"partNumber": 1e20}', '{"partNumber": 6, "groups": [{"pages": [1e20, 2, 2.0], "page": 1e12, "questions": [{"questionText": "q"}]}]}', '{"partNumber": -1e300}', "[]", "nonsense"]
    rows = spark.createDataFrame([(k, r, None) for k, r in enumerate(raw)], "key int, raw string, expected int")
    got = {r.key: r for r in coercion.parts(rows).collect()}
    assert {k: r.error for k, r in got.items()} == {0: "part number", 1: None, 2: "part number", 3: "not an object", 4: "not an object"}
    assert got[1].pages == [2] and got[1].page is None and got[1].question_number == 131


def test_a_document_with_all_questions(spark):
    """Four questions a page: every part has its questions once, with stem, options and letter; lines are folded for all parts at once."""
    page, exam = [], ["PART 5", "PART 6"]
    for n in range(32, 201):
        at, y = (n - 32) // 4 + 2, 0.05 + 0.22 * ((n - 32) % 4)
        page += [(at, f"{n}. What is the answer to number {n}?", 0.08, y), *((at, f"({c}) choice {c} of {n}", 0.08, y + 0.03 * (k + 1)) for k, c in enumerate("ABCD"))]
        exam += [f"Questions {n}-{n + 3} refer to the following notice.", f"A notice for number {n} that is long enough to count"] if 131 <= n <= 143 and (n - 131) % 4 == 0 else ["PART 7"] if n == 147 else []
        exam.append(f"{n}. What is the answer to number {n}?")
    rows = spans(spark, *page)
    key = spark.createDataFrame([(1, n, "ABCD"[n % 4]) for n in range(101, 201)], "doc_id long, question_number int, letter string")
    docs = spark.createDataFrame([(1, "\n".join(exam), "PART 1\nPART 2\n7. W-Am Where?\n(A) here\n8. x")], "doc_id long, text string, key_text string")
    whole = booklet.document(docs, rows, spark.createDataFrame([], IMAGES), key).collect()
    found = {p: sorted(q.question_number for r in whole if r.part_number == p for q in r.questions) for p in range(1, 8)}
    assert found == {p: list(range(a, b + 1)) for p, (a, b, _) in PART_RANGES.items()}
    for r in whole:
        for q in r.questions:
            if q.question_number > 100:
                assert (q.question_text, q.options[3], q.letter) == (f"What is the answer to number {q.question_number}?", f"choice D of {q.question_number}", "ABCD"[q.question_number % 4])
                assert r.part_number == 7 or (q.question_number - 32) // 4 + 2 in r.pages
    six = sorted((r.first_question, r.passage) for r in whole if r.part_number == 6)
    assert [f for f, _ in six] == [131, 135, 139, 143] and all(f"A notice for number {f}" in p for f, p in six)


def test_two_writers_and_tables_left_out(spark, tmp_path):
    folder = f"file://{tmp_path}/tables"
    one, two = spark.range(3), spark.range(5)
    first = versions.write_version(spark, folder, {"a": one, "b": two})
    second = versions.write_version(spark, folder, {"a": two})
    assert [p.name for p in (tmp_path / "tables" / second.rpartition("/")[2]).iterdir() if p.is_dir()] == ["a"]  # b is not written again
    assert versions.read(spark, folder, "a").count() == 5 and versions.read(spark, folder, "b").count() == 5
    with pytest.raises(versions.Moved):
        versions.write_version(spark, folder, {"a": one}, base=first)
    assert versions.current(spark, folder) == second and versions.read(spark, folder, "a").count() == 5
    assert {p.name for p in (tmp_path / "tables").iterdir() if p.name.startswith("v-")} == {first.rpartition("/")[2], second.rpartition("/")[2]}


def test_a_guard_that_fails_leaves_the_version_before(spark, tmp_path):
    folder, reads = f"file://{tmp_path}/guarded", tmp_path / "reads"
    reads.mkdir()

    def counted(frames):
        (reads / str(len(list(reads.iterdir())))).touch()
        yield from frames

    some = {"some": F.count(F.lit(1)) > 0}
    versions.write_version(spark, folder, {"a": spark.range(3)}, {"a": some})
    rows = spark.range(4).coalesce(1).mapInPandas(counted, "id long")
    with pytest.raises(versions.GuardFailed, match="a: no three"):
        versions.write_version(spark, folder, {"a": rows, "b": spark.range(1)}, {"a": {**some, "no three": F.count_if(F.col("id") == 3) == 0}})
    assert len(list(reads.iterdir())) == 1  # the guard costs no scan of its own
    assert versions.read(spark, folder, "a").count() == 3 and "b" not in versions.tables_of(spark, versions.current(spark, folder))
    with pytest.raises(versions.GuardFailed, match="a: some"):
        versions.write_version(spark, folder, {"a": spark.range(0)}, {"a": some})


def test_a_row_step_goes_on_with_what_came(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/job", tmp_path / "calls"
    calls.mkdir()

    def work(row, partial):
        with open(calls / str(row["k"]), "a") as out:
            out.write("x")
        if row["k"] == 2 and partial is None:
            raise stages.PartialOutput("cut", "half")
        if row["k"] == 3 and len((calls / "3").read_text()) < 3:
            raise ValueError("not yet")
        return {"text": f"{partial or ''}{row['k']}"}

    step = stages.RowStep(lambda s, results: s.range(4).withColumnRenamed("id", "k").repartition(4), "k", work, "text string")
    for left in (2, 1):
        with pytest.raises(stages.RowsFailed, match=f"{left} rows failed"):
            stages.run_steps(spark, folder, "j", [("parse", step)])
    assert stages.run_steps(spark, folder, "j", [("parse", step)]) == {"parse": "done"}
    assert {r.k: r.text for r in spark.read.parquet(f"{folder}/j/parse").collect()} == {0: "0", 1: "1", 2: "half2", 3: "3"}
    assert {p.name: len(p.read_text()) for p in calls.iterdir()} == {"0": 1, "1": 1, "2": 2, "3": 3}
    assert stages.states(spark, folder).first().status == "done"


def test_objects_appear_all_or_none(spark, tmp_path):
    folder = f"file://{tmp_path}/objects"
    here = lambda: {str(p.relative_to(tmp_path / "objects")): p.read_bytes() for p in (tmp_path / "objects").rglob("*") if p.is_file() and ".staging" not in str(p)}
    rows = spark.createDataFrame([("a/b.txt", b"one"), ("c.txt", None), ("d", b"\x00\xff")], "key string, content binary")
    objects.put(rows, folder)
    assert here() == {"a/b.txt": b"one", "c.txt": b"", "d": b"\x00\xff"}

    def failing(frames):
        for pdf in frames:
            if (pdf["key"] == "bad").any():
                raise ValueError("lost")
            yield pdf

    more = spark.createDataFrame([("a/b.txt", b"two"), ("bad", b"x"), ("e", b"y")], "key string, content binary").repartition(3, "key")
    for broken in (more.mapInPandas(failing, "key string, content binary"), spark.createDataFrame([("../f", b"x"), ("g", b"y")], "key string, content binary")):
        with pytest.raises(Exception, match="lost|no key"):
            objects.put(broken, folder)
        assert here() == {"a/b.txt": b"one", "c.txt": b"", "d": b"\x00\xff"}
    objects.put(more.where("key <> 'bad'"), folder)
    assert here() == {"a/b.txt": b"two", "c.txt": b"", "d": b"\x00\xff", "e": b"y"}


def test_direct_import_takes_whole_tests_only(spark, tmp_path):
    folder = f"file://{tmp_path}/imports"
    uploads = [(1, f, k, f"{f}.PDF") for k, f in enumerate(("examPdf", "keyLcPdf", "keyRcImage", "extra", "examPdf"))] + [(2, "examPdf", 0, "a"), (3, "other", 0, "b.png")]
    uploads = spark.createDataFrame(uploads, "test_id long, field string, place int, name string")
    parsed = spark.createDataFrame([(1, 5, 101), (1, 5, 102), (1, 6, 131), (2, 5, 101)], "test_id long, part_number int, question_number int")
    versions.write_version(spark, folder, {"questions": spark.createDataFrame([(1, 5, 199), (2, 5, 198)], parsed.schema)})
    got = {r.test_id: r for r in imports.direct_import(spark, folder, uploads, parsed).collect()}
    assert {k: (r.status, r.files, r.total_questions, r.parts) for k, r in got.items()} == {1: ("DONE", 3, 3, {5: 2, 6: 1}), 2: ("REFUSED", 1, None, None), 3: ("REFUSED", 0, None, None)}
    assert sorted((r.test_id, r.question_number) for r in versions.read(spark, folder, "questions").collect()) == [(1, 101), (1, 102), (1, 131), (2, 198)]
    assert {r.key for r in versions.read(spark, folder, "files").collect()} == {"exams/toeic/1/exam.pdf", "answers/toeic/1/key-lc.pdf", "images/toeic/1/key-rc.pdf"}
    before = versions.current(spark, folder)
    with pytest.raises(versions.GuardFailed):
        imports.direct_import(spark, folder, uploads, parsed.withColumn("question_number", F.lit(None).cast("int")))
    assert versions.current(spark, folder) == before


def test_pages_are_read_once_for_reading_groups(spark):
    """Every join of the questions read all pages again."""
    rows = spans(spark, (1, "147. Why was it written", 0.08, 0.1), *options(1, 0.08, 0.12))
    key = spark.createDataFrame([(1, 147, "D")], "doc_id long, question_number int, letter string")
    docs = spark.createDataFrame([(1, "PART 7\nQuestions 147-148 refer to the following letter.\nDear all, this is the letter of the day\n147. y")], "doc_id long, text string")
    groups = booklet.reading_groups(docs, rows, key, 7)
    assert "ArrowEvalPython" not in groups._jdf.queryExecution().executedPlan().toString()
    assert [(g.page, g.first_question, [(q.question_number, q.letter) for q in g.questions]) for g in groups.collect()] == [(1, 147, [(147, "D")])]


def test_lines_of_plain_pages_need_no_fold_by_values(monkeypatch):
    """Every span became a Python value; now only lines of several spans do, and pages with missing or tied places."""
    kind = pa.list_(pa.list_(pa.struct([(n, pa.string() if n == "text" else pa.float64()) for n in ("y", "x", "w", "h", "text")])))
    span = lambda y, x, text: {"y": y, "x": x, "w": 0.1, "h": 0.01, "text": text}
    plain = [[[span(0.3, 0.1, " b  c\xa0"), span(0.1, 0.5, "B"), span(0.109, 0.1, "A"), span(0.118, 0.1, "C"), span(0.13, 0.1, "")], None, []], None, [], [[span(0.5, 0.1, "x"), span(0.512, 0.2, "y"), span(0.524, 0.3, "z")]]]
    odd = [[[span(None, 0.1, "a"), span(float("nan"), 0.1, "b"), span(0.1, None, "c")]], [[span(0.1, 0.1, "e"), span(0.1, 0.1, "d")]]]
    fold = layout.folded_lines
    want = lambda rows: [None if row is None else [fold([tuple(s.values()) for s in spans or []]) for spans in row] for row in rows]
    assert str(layout._lines_of(pa.array(odd + plain, kind)).to_pylist()) == str(want(odd + plain))
    assert layout._lines_of(pa.array([[], None, [[], None]], kind)).to_pylist() == [[], None, [[], []]]
    monkeypatch.setattr(layout, "folded_lines", None)
    got = layout._lines_of(pa.array(odd + plain, kind).slice(2)).to_pylist()
    assert got == want(plain) and [z["line"] for z in got[0][0]] == ["A B", "C", "", "b c"]


def test_options_are_read_once_for_a_question(spark):
    """Filters on the options' number and on the place of (A) were computed again below their columns."""
    rows = spans(spark, (1, "101. Some stem of part five", 0.08, 0.1), *options(1, 0.08, 0.12))
    plan = booklet.page_questions(layout.page_model(rows), [(101, 130)])._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and not [line for line in plan.splitlines() if "Filter" in line and "[.)]" in line]


def test_listening_keys_with_white_space_of_any_kind(spark):
    docs = spark.createDataFrame([(1, "\u3000 7. a\xa0\r\n8 (B)\ufeff\n9) c x\nx 10. D\n11:d\u2028\n12. E")], "doc_id long, text string")
    assert {r.question_number: r.letter for r in extraction.listening_key(docs).collect()} == {7: "A", 8: "B", 11: "D"}

import pytest
from pyspark.sql import functions as F

from quizmill.functions.numbers import clamped_box, half_up, overlap_share, raised_box, remapped
from quizmill.operators import layout

SPANS = "doc_id long, page int, idx int, text string, x double, y double, w double, h double"


def spans(spark, *rows):
    return spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)], SPANS)


def test_two_columns(spark):
    got = layout.page_columns(spans(spark, ("101.", 0.08, 0.2, 0.04, 0.02), ("105.", 0.55, 0.2, 0.04, 0.02))).first()
    assert got.dual and got.split_x >= 0.45
    one = layout.page_columns(spans(spark, ("101.", 0.08, 0.2, 0.04, 0.02), ("text", 0.55, 0.2, 0.04, 0.02))).first()
    assert not one.dual and one.split_x == 0.5


def test_reading_order(spark):
    s = spans(spark, ("106. d", 0.55, 0.5, 0.1, 0.02), ("105. c", 0.55, 0.2, 0.1, 0.02), ("102. b", 0.08, 0.5, 0.1, 0.02), ("101. a", 0.08, 0.2, 0.1, 0.02))
    assert [r.text[5:] for r in layout.reading_order(s).orderBy("place").collect()] == list("abcd")


def test_anchors_stay_in_their_column(spark):
    s = spans(spark, ("101. a", 0.08, 0.2, 0.1, 0.02), ("102. b", 0.08, 0.5, 0.1, 0.02), ("105. c", 0.55, 0.3, 0.1, 0.02), ("tail", 0.1, 0.25, 0.1, 0.02))
    found = layout.anchors(s)
    assert {r.number: r.next_y for r in found.collect()} == {101: 0.5, 102: None, 105: None}
    assert {(r.number, r.text) for r in layout.band(s, found).collect()} == {(101, "101. a"), (101, "tail"), (102, "102. b"), (105, "105. c")}


@pytest.mark.parametrize(
    ("parts", "line"),
    [
        ([(0.08, 0.02, "101"), (0.11, 0.005, "."), (0.13, 0.1, "Adalet Farm")], "101. Adalet Farm"),
        ([(0.0875, 0.0159, "11"), (0.1034, 0.01, "2."), (0.13, 0.1, "Adalet Farm")], "112. Adalet Farm"),
        ([(0.2, 0.08, "area"), (0.335, 0.006, "w"), (0.342, 0.02, "ill"), (0.37, 0.05, "be closed")], "area will be closed"),
        ([(0.1, 0.1, "see ("), (0.2, 0.1, "a)")], "see (a)"),
    ],
)
def test_joined_line(spark, parts, line):
    rows = spark.createDataFrame([(sorted(parts),)], "parts array<struct<x:double,w:double,text:string>>")
    assert rows.select(layout.joined(F.col("parts")).alias("line")).first().line == line


def test_lines_count_from_the_head(spark):
    s = spans(spark, ("a", 0.1, 0.1, 0.01, 0.01), ("bb", 0.2, 0.11, 0.01, 0.01), ("cc", 0.3, 0.12, 0.01, 0.01))
    assert [r.line for r in layout.lines(s).orderBy("y").collect()] == ["a bb", "cc"]


def test_near_median(spark):
    s = spans(spark, ("1. a", 0.08, 0.1, 0.1, 0.01), ("2. b", 0.09, 0.2, 0.1, 0.01), ("3. c", 0.3, 0.3, 0.1, 0.01))
    assert {r.number for r in layout.near_median(layout.anchors(s)).collect()} == {1, 2}


def test_word_regions(spark):
    rows = layout.word_regions(spans(spark, ("The regional manager", 0.1, 0.2, 0.4, 0.02))).orderBy("x").collect()
    assert [r.word for r in rows] == ["The", "regional", "manager"]
    assert rows[0].w < 0.4 and rows[0].x < rows[1].x < rows[2].x


def box(spark, expression):
    return spark.range(1).select(expression.alias("b")).first().b


def at(x, y, w, h):
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("xywh", (x, y, w, h), strict=True)])


def test_boxes(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert box(spark, clamped_box(*lit(0, 0, 0.01, 0.5))) is None
    assert tuple(box(spark, clamped_box(*lit(0.1, 0.2, 0.3, 0.4)))) == (0.1, 0.2, 0.3, 0.4)
    assert tuple(box(spark, raised_box(*lit(-1, 0.2, 0.001, 0.4)))) == (0.0, 0.2, 0.02, 0.4)
    crop = at(0.2, 0.2, 0.5, 0.5)
    assert box(spark, overlap_share(at(0.25, 0.25, 0.1, 0.1), crop)) == pytest.approx(1)
    assert box(spark, overlap_share(at(0, 0, 0.05, 0.05), crop)) == 0
    assert box(spark, overlap_share(at(0, 0, 0, 0.05), crop)) == 0
    moved = box(spark, remapped(at(0.3, 0.3, 0.1, 0.05), crop))
    assert (moved.x, moved.y) == (pytest.approx(0.2), pytest.approx(0.2))
    assert box(spark, remapped(at(0, 0, 0.1, 0.1), crop)) is None
    assert box(spark, half_up(F.lit(-2.5))) == -2


@pytest.mark.parametrize("text", ["118.24.5.6", "x46.104.192.150 too", "at 129.95 euros"])
def test_numbers_in_addresses_and_decimals_are_no_questions(spark, text):
    rows = spans(spark, ("word", 0.08, 0.1, 0.1, 0.02), (text, 0.08, 0.2, 0.1, 0.02), ("end", 0.08, 0.3, 0.1, 0.02))
    assert layout.question_anchors(rows, 101, 130).collect() == []
    assert layout.pages_of_part(layout.page_model(rows), 5).collect() == []


def test_a_long_page_takes_time_as_its_spans_do(spark):
    """Every line was cut out of all spans of its page anew: 20,000 lines took minutes."""
    import time

    s = spark.range(20000).selectExpr("1L AS doc_id", "1 AS page", "CAST(id AS int) AS idx", "concat('w', id) AS text", "0.1D AS x", "id * 0.02D AS y", "0.1D AS w", "0.01D AS h")
    start = time.time()
    rows = layout.lines(s).orderBy("y").collect()
    assert [r.line for r in rows] == [f"w{k}" for k in range(20000)] and time.time() - start < 30


def test_lines_in_any_order_with_nulls_and_wide_spaces(spark):
    s = spans(spark, ("b　", 0.2, 0.1, 0.01, 0.01), (" a", 0.1, 0.1, 0.01, 0.01), (None, 0.3, 0.1, 0.01, 0.01), (",", 0.4, 0.105, 0.01, 0.01), ("e  f", 0.1, 0.2, 0.01, 0.01))
    assert [(r.line, r.x) for r in layout.lines(s).orderBy("y").collect()] == [("a b,", 0.1), ("e f", 0.1)]


def test_bands_shuffle_what_is_asked_for(spark):
    """Texts and widths went through the shuffle of bands that only count."""
    s = spans(spark, ("101. a", 0.08, 0.2, 0.1, 0.02), ("102. b", 0.08, 0.5, 0.1, 0.02), ("tail", 0.1, 0.25, 0.1, 0.02))
    rows = layout.label_bands(s, ())
    assert rows.columns == ["doc_id", "page", "number"] and sorted(r.number for r in rows.collect()) == [101, 101, 102]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "h, h#" in plan and "text, text#" not in plan and "w, w#" not in plan
    assert {(r.number, r.text) for r in layout.label_bands(s).collect()} == {(101, "101. a"), (101, "tail"), (102, "102. b")}


WORDS = [
    (1, 0), (2, 3), (3, 99), (4, 100), (5, 101), (6, 230), (7, 400), (8, 150), (9, 1001), (11, 221), (11, 120), (12, 7), (12, 335), (14, 200), (None, 130),
]


@pytest.fixture
def odd_documents(spark, tmp_path):
    """Documents of up to eleven pages, some ids twice or missing, with empty words, line breaks and no text at all."""
    texts = [(d, " ".join(("", "Ünit\n", f"w{k}", "x.")[k % 7 % 4] for k in range(n))) for d, n in WORDS]
    rows = [*texts, (20, None), (21, "  "), (22, "PART 5"), (23, "🙂 " * 100), (24, "only\nlines")]
    spark.createDataFrame([(*r, "web") for r in rows], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_section_texts_of_pages_are_those_of_spans(spark, odd_documents):
    from quizmill.catalog import QUERIES
    from quizmill.queries.listings import headed
    from quizmill.sources.tables import Tables

    s = headed(Tables(spark, odd_documents))
    inside = layout.pages_of_part(layout.page_model(s), 5)
    said = layout.reading_order(s).join(inside, ["doc_id", "page"], "left_semi").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct((F.col("column") == "right").alias("r"), "y", "x", "idx", "text"))).alias("s"))
    pages = {}
    for r in said.orderBy("doc_id", "page").collect():
        pages.setdefault(r.doc_id, []).append(" ".join(z.text for z in r.s))
    want = {d: "\n\n".join(texts) for d, texts in pages.items()}
    assert len(want) >= 15 and max(map(len, pages.values())) >= 3
    assert dict(layout.section_texts(layout.page_model(s), 5).collect()) == want
    hashes = spark.createDataFrame(list(want.items()), "doc_id long, text string").select("doc_id", F.md5("text"))
    assert dict(QUERIES["x19_layout_text"](spark, odd_documents).collect()) == dict(hashes.collect())


def test_section_texts_shuffle_texts_only(spark, odd_documents):
    """Every span went through the shuffle with its box, once for the pages and once for the part's, which were joined."""
    from quizmill.catalog import QUERIES

    plan = QUERIES["x19_layout_text"](spark, odd_documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan and plan.count("FileScan") == 1 and "hashpartitioning(doc_id" in plan
    read = plan[plan.rindex("Exchange") :]
    assert "FileScan" in read and "Generate" not in read

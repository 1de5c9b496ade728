"""Sections, question blocks and assembled questions of exam booklets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.functions.numbers import part_of_number
from quizmill.model import GRAPHIC_STARTS, PART_RANGES
from quizmill.operators import extraction, graphics, layout
from quizmill.operators.extraction import OPTION, part_slices, passages
from quizmill.plans.scratch import written

# How a speaker's line opens, and options inside one.
_SPEAKER = r"(?i)^(?:W|M)\s*[-–]?\s*[A-Za-z]{2,4}\s*"
_INSIDE = r"(?i)\(([A-D])\)\s*([^(\n]+?)(?=\s*\([A-D]\)|$)"


def sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, part_number, section) for parts 1 to 7; a part without a header has the whole text."""
    parts = docs.select(key, "text", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("part_number"))
    found = part_slices(docs, key)
    return parts.join(found, [key, "part_number"], "left").select(key, "part_number", F.coalesce("section", "text").alias("section"))


def question_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, question_number, block): text from each line that opens with a number up to the next such line; the first of a number counts."""
    head = r"(?m)^[ \t]*(?=\d{1,3}[ \t]*(?:[.):]|$))"
    pieces = docs.select(key, F.posexplode(F.split("text", head)).alias("pos", "piece"))
    opening = r"^(\d{1,3})\s*(?:[.):]|\n|$)"
    rows = pieces.where(F.col("piece").rlike(opening)).select(key, "pos", F.regexp_extract("piece", opening, 1).try_cast("int").alias("question_number"), F.regexp_replace("piece", opening, "").alias("block"))
    return rows.groupBy(key, "question_number").agg(F.min_by("block", "pos").alias("block"))


def blocks_to_next(docs: DataFrame, ends: list[int], keys: list[str]) -> DataFrame:
    """(keys, question_number, block): text behind the line that opens with q, up to the next line that opens with q + 1.

    The first line of q with such a line behind it counts. A number in ``ends`` runs
    to the end of the text; any other number without its successor has no block.
    """
    head = r"(?m)^[ \t]*(?=\d{1,3}[ \t]*(?:[.):]|$))"
    opening = r"^(\d{1,3})\s*(?:[.):]|\n|$)"
    pieces = layout.settled(docs.select(*keys, "text"), pieces=F.split("text", head)).drop("text")
    pieces = layout.settled(pieces, numbers=F.transform("pieces", lambda p: F.regexp_extract(p, opening, 1).try_cast("int")))
    count = F.size("numbers")

    def sized(number: Column, i: Column) -> Column:
        """(number, place, pieces up to the one that opens with the next number)."""
        ahead = F.array_position(F.slice("numbers", i + 2, F.greatest(F.lit(1), count)), number + 1).cast("int")
        return F.struct(number.alias("number"), i.alias("at"), F.when(ahead > 0, ahead).when(number.isin(*ends), count - i).alias("size"))

    # A text's blocks are found and joined on its own row: the text is never copied to its lines.
    spans = F.array_sort(F.filter(F.transform("numbers", sized), lambda z: z["size"].isNotNull() & z["number"].isNotNull()))
    pieces = layout.settled(pieces, _spans=spans)
    firsts = F.filter("_spans", lambda z, i: (i == 0) | (F.get("_spans", i - 1)["number"] != z["number"]))
    block = lambda z: F.regexp_replace(F.array_join(F.slice("pieces", z["at"] + 1, z["size"]), ""), opening, "")
    blocks = F.transform(firsts, lambda z: F.struct(z["number"].alias("question_number"), block(z).alias("block")))
    return pieces.select(*keys, F.inline(blocks))


def bounded(text: Column, starts: list[str], end: str | None) -> Column:
    """The text from the first of several patterns that occurs up to the end pattern, 8 characters on at the earliest; all of it without a start."""
    places = [F.regexp_instr(text, F.lit(p)) for p in starts]
    start = F.coalesce(*[F.when(p > 0, p) for p in places])
    tail = F.substr(text, start)
    stop = F.regexp_instr(F.substr(tail, F.lit(9)), F.lit(end)) if end else F.lit(0)
    return F.when(start.isNull(), text).otherwise(F.when(stop > 0, F.substr(tail, F.lit(1), stop + 7)).otherwise(tail))


def part_section(text: Column, part: int) -> Column:
    """A part's section of an exam text, by its header up to the next part's (part 5's header is often read as PARTS)."""
    header = lambda n: rf"(?i)\bPART\s*{n}\b"
    starts = [r"(?i)\bPARTS\b", r"(?:^|\n)\s*101\.\s"] if part == 5 else [header(part)]
    return bounded(text, starts, header(part + 1) if part < 7 else None)


def block_options(block: Column) -> Column:
    """Options of a block: option lines, else labels inside speaker lines, in order."""
    kept = F.filter(F.transform(T.lines(block), lambda line: T.strip_quotes(T.trim(line))), lambda line: line != "")
    each = F.transform(kept, lambda line: F.when(line.rlike(OPTION), F.array(T.trim(F.regexp_extract(line, OPTION, 2)))).otherwise(F.transform(F.regexp_extract_all(line, F.lit(_INSIDE), F.lit(2)), T.trim)))
    return F.filter(F.flatten(each), lambda o: o != "")


def conversation_stem(block: Column, number: Column) -> Column:
    """Text in front of the first option, without key lines and speakers; ``Question n`` if nothing is left."""
    kept = F.filter(F.transform(T.lines(block), T.trim), lambda line: (line != "") & ~T.is_answer_key_line(line))
    stops = F.transform(kept, lambda line: T.strip_quotes(line).rlike(OPTION) | line.rlike(r"(?i)\([A-D]\)"))
    place = F.array_position(stops, F.lit(True))
    before = F.when(place > 0, F.slice(kept, 1, F.greatest(place - 1, F.lit(0)).cast("int"))).otherwise(kept)
    said = F.filter(before, lambda line: ~line.rlike(r"(?i)^(?:W|M)\s*[-–]"))
    return T.or_default(T.trim(T.collapse(F.array_join(said, " "))), F.concat(F.lit("Question "), number.cast("string")))


def response_stem(block: Column, number: Column) -> Column:
    """The spoken line of a question-response item: a speaker's line, else a question, else the first line."""
    lines = F.filter(F.transform(T.lines(block), T.trim), lambda line: (line != "") & ~T.strip_quotes(line).rlike(OPTION) & ~line.rlike(r"(?i)^\([A-D]\)") & ~T.is_answer_key_line(line))
    spoken = F.get(F.filter(lines, lambda line: line.rlike(r"(?i)^(?:W|M)\s*[-–]") & ~line.rlike(r"(?i)\([A-D]\)")), 0)
    asked = F.get(F.filter(lines, lambda line: line.contains("?") & ~line.rlike("[\u0080-￿]{4,}")), 0)
    return T.or_default(T.trim(F.regexp_replace(F.coalesce(spoken, asked, F.get(lines, 0)), _SPEAKER, "")), F.concat(F.lit("Question "), number.cast("string")))


def best_candidates(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of several readings (key, question_number, pos, options) the one with most real options, then the first."""
    real = F.size(F.filter("options", lambda o: o != "-"))
    return rows.groupBy(key, "question_number").agg(F.max_by("options", F.struct(real.alias("n"), (-F.col("pos")).alias("first"))).alias("options"))


def repaired(items: DataFrame, from_layout: DataFrame, key: str = "doc_id") -> DataFrame:
    """Garbled items (key, question_number, question_text, options) replaced by the layout's reading when that has three clean options."""
    clean = F.size(F.filter("l_options", lambda o: ~o.isin("", "-") & ~T.is_garbled(o)))
    other = from_layout.select(key, "question_number", F.col("question_text").alias("l_text"), F.col("options").alias("l_options")).where(clean >= 3)
    rows = items.join(other, [key, "question_number"], "left")
    broken = (T.is_garbled(F.col("question_text")) | F.exists("options", T.is_garbled)) & F.col("l_options").isNotNull()
    return rows.select(key, "question_number", F.when(broken, F.col("l_text")).otherwise(F.col("question_text")).alias("question_text"), F.when(broken, F.col("l_options")).otherwise(F.col("options")).alias("options"))


def page_questions(model: DataFrame, ranges: list[tuple[int, int]], exclude: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, of, number, stem, options): the questions of a page model (see ``layout.page_model``), without leaving a page's row.

    Each anchor's band is read as lines, with two options at least. The stem stands
    in front of the line with (A); one of under 8 characters gives way to text
    behind the number on an earlier line of the page. Four options. ``of`` is the range
    (see ``layout.with_anchors``). Spans in ``exclude`` boxes (doc_id, page, x, y, w, h) are left out.
    """
    rows = layout.with_anchors(model, ranges)
    kept = F.col("spans")
    if exclude is not None:
        rows = rows.join(exclude.groupBy(*layout.PAGE).agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("_boxes")), layout.PAGE, "left")
        kept = F.filter("spans", lambda s: F.col("_boxes").isNull() | ~F.exists("_boxes", lambda b: layout.covers(b, s)))
    rows = layout.with_lines(layout.settled(rows, _spans=kept), F.transform("anchors", lambda a: F.filter("_spans", lambda s: layout.in_band(s, a))), "_said")
    rows = rows.select(*layout.PAGE, "lines", F.explode(F.arrays_zip("anchors", "_said")).alias("q"))
    rows = rows.select(*layout.PAGE, "lines", F.col("q.anchors.of").alias("of"), F.col("q.anchors.number").alias("number"), F.col("q.anchors.y").alias("_y"), F.transform("q._said", lambda z: z["line"]).alias("l"))
    place = F.array_position(F.transform("l", lambda line: line.rlike(r"(?i)\(A\)")), F.lit(True)).cast("int")
    # Settled, as a filter is computed again below a plain column.
    rows = layout.settled(rows, place=place, digits=F.col("number").cast("string")).where("place > 0")
    opening = r"^\s*(\d{1,3})\s*\.\s*"
    unnumbered = lambda text: F.when(F.regexp_extract(text, opening, 1) == F.col("digits"), F.regexp_replace(text, opening, "")).otherwise(text)
    below = F.transform(F.slice("l", F.col("place"), F.size("l")), lambda line, i: T.trim(F.when(i == 0, unnumbered(line)).otherwise(line)))
    bare = r"(?i)^\(([A-D])\)\s*(.+)$"
    options = F.filter(F.transform(below, lambda line: F.when(line.rlike(OPTION), T.trim(F.regexp_extract(line, OPTION, 2))).when(line.rlike(bare), T.trim(F.regexp_extract(line, bare, 2)))), lambda o: o.isNotNull())
    rows = layout.settled(rows, options=options).where(F.size("options") >= 2)
    rows = layout.settled(rows, head=T.trim(T.collapse(unnumbered(F.array_join(F.slice("l", 1, F.col("place") - 1), " ")))))
    # Text behind the number inside an earlier line, for stems that are hardly there: left column first, then by y.
    numbers = lambda line: F.regexp_extract_all(line, F.lit(r"\b(\d{1,3})\s*\.\s*(?=.)"), F.lit(1))
    named = F.filter("lines", lambda z: (z["y"] < F.col("_y")) & F.array_contains(numbers(z["line"]), F.col("digits")))
    named = F.array_sort(F.transform(named, lambda z: F.struct((z["column"] == "right").alias("right"), z["y"].alias("y"), z["line"].alias("line"))))
    earlier = F.get(F.when(F.length("head") < 8, named), F.lit(0))["line"]
    inline = F.concat(F.lit(r"^.*?\b"), F.col("digits"), F.lit(r"\s*\.\s*(?=.)"))
    rows = rows.withColumn("_earlier", earlier).withColumn("_other", T.trim(T.collapse(T.dashes_to_spaces(F.when(F.col("_earlier").isNotNull(), F.regexp_replace("_earlier", inline, F.lit("")))))))
    stem = F.coalesce(F.when(F.col("_other") != "", F.col("_other")), F.when(F.col("head") != "", F.col("head")), F.concat(F.lit("Question "), F.col("digits")))
    return rows.select(*layout.PAGE, "of", "number", stem.alias("stem"), T.padded(F.col("options"), 4).alias("options"))


def with_letters(questions: DataFrame, answers: DataFrame | None) -> DataFrame:
    """Questions with the letter of ``answers`` (doc_id, question_number, letter), null without one."""
    columns = ["doc_id", "page", "number", "stem", "options", "letter"]
    if answers is None:
        return questions.withColumn("letter", F.lit(None).cast("string")).select(*columns)
    return questions.join(answers.select("doc_id", F.col("question_number").alias("number"), "letter"), ["doc_id", "number"], "left").select(*columns)


def layout_questions(spans: DataFrame, answers: DataFrame | None = None, first: int = 1, last: int = 999, exclude: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, number, stem, options, letter): the questions of ``page_questions``, with their letters."""
    return with_letters(page_questions(layout.page_model(spans), [(first, last)], exclude), answers)


def listening_parts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, part_number, first_question, question_number, stem, options, letter, transcript) of parts 1 to 4 of a listening key's text.

    A part without a header of its own is read from the whole text. Photo questions
    take the statement sets in their order; the others their block up to the next
    number, part 2 with three options and the rest with four.
    """
    answers = extraction.listening_key(docs, key=key)
    heads = sections(docs, key).where("part_number < 5")
    ends = [PART_RANGES[p][1] for p in (2, 3, 4)]
    blocks = blocks_to_next(heads.where("part_number > 1").select(key, "part_number", F.col("section").alias("text")), ends, [key, "part_number"])
    every = docs.select(key, F.explode(F.sequence(F.lit(PART_RANGES[2][0]), F.lit(PART_RANGES[4][1]))).alias("question_number")).withColumn("part_number", part_of_number(F.col("question_number")))
    rows = every.join(blocks, [key, "part_number", "question_number"], "left").withColumn("block", F.coalesce("block", F.lit("")))
    stem = F.when(F.col("part_number") == 2, response_stem(F.col("block"), F.col("question_number"))).otherwise(conversation_stem(F.col("block"), F.col("question_number")))
    rows = rows.select(key, "question_number", stem.alias("stem"), block_options(F.col("block")).alias("options"))
    items = extraction.listening_items(rows, answers, extraction.transcripts(heads, key), key)
    items = items.withColumn("first_question", F.when(F.col("part_number") == 2, F.col("question_number")).otherwise(extraction.group_start(F.col("question_number"), F.col("part_number"))))
    photos = extraction.photo_questions(docs, key).join(answers, [key, "question_number"], "left")
    photos = photos.select(key, F.lit(1).alias("part_number"), F.col("question_number").alias("first_question"), "question_number", F.lit("What is the best description of the photograph?").alias("stem"), "options", "letter", F.lit(None).cast("string").alias("transcript"))
    return photos.unionByName(items.select(*photos.columns))


def first_page(rows: DataFrame, preferred: Column) -> DataFrame:
    """One reading per (doc_id, number): pages of the expected range first, then page order."""
    order = Window.partitionBy("doc_id", "number").orderBy(F.when(preferred, 0).otherwise(1), "page")
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def _question(number: str = "number") -> Column:
    return F.struct(F.col(number).alias("question_number"), F.col("stem").alias("question_text"), "options", "letter")


def part5_groups(spans: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, page, pages, first_question, passage, questions): part 5's questions by page, in order of their numbers."""
    first, last, _ = PART_RANGES[5]
    return by_page(layout_questions(spans, answers, first, last))


def by_page(rows: DataFrame) -> DataFrame:
    """Groups of questions (see ``layout_questions``), one for each page."""
    groups = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(_question())).alias("questions"))
    return groups.select("doc_id", "page", F.array("page").alias("pages"), F.get("questions", F.lit(0))["question_number"].alias("first_question"), F.lit(None).cast("string").alias("passage"), "questions")


def passage_pages(texts: DataFrame) -> DataFrame:
    """(doc_id, first_question, last_question, page): the first page whose text has a passage's header."""
    header = r"(?i)Questions?\s+(\d{1,3})\s*-\s*(\d{1,3})"
    pairs = F.zip_with(F.regexp_extract_all("page_text", F.lit(header), F.lit(1)), F.regexp_extract_all("page_text", F.lit(header), F.lit(2)), lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))
    rows = texts.select("doc_id", "page", F.explode(pairs).alias("p"))
    return rows.groupBy("doc_id", F.col("p.a").alias("first_question"), F.col("p.b").alias("last_question")).agg(F.min("page").alias("page"))


def passage_pages_of_spans(spans: DataFrame) -> DataFrame:
    """``passage_pages`` of the texts of ``spans``; texts without a part of a header are shuffled as a mark.

    A header may run over several spans: what can open or go on with one keeps its text, anything else only parts its neighbours.
    """
    part = F.col("text").rlike(r"(?i)question|^[\s\d-]|^$")
    return passage_pages(layout.page_texts(spans.withColumn("text", F.when(part, F.col("text")).when(F.col("text").isNotNull(), "x"))))


def reading_groups(docs: DataFrame, spans: DataFrame, answers: DataFrame, part: int, chunk: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, page, pages, first_question, passage, questions) of part 6 or 7.

    A passage's questions come from the pages; its page is that of its header, else
    of its first question, and its pages run to its last question's. In part 7,
    runs of numbers that no passage has become groups of their own. ``chunk`` keeps
    passages that meet it, and questions within it. ``docs`` has doc_id and text.
    The pages are read once: their questions, which several joins need, are written
    to the session's shared folder.
    """
    first, last, _ = PART_RANGES[part]
    return groups_of(docs, layout.page_texts(spans), written(layout_questions(spans, answers, first, last), "questions"), part, chunk)


def groups_of(docs: DataFrame, texts: DataFrame, questions: DataFrame, part: int, chunk: tuple[int, int] | None = None) -> DataFrame:
    """``reading_groups`` from questions already read (see ``layout_questions``) and texts of pages (doc_id, page, page_text)."""
    first, last, _ = PART_RANGES[part]
    low, high = chunk or (first, last)
    found = questions.where(F.size(F.filter("options", lambda o: o != "-")) >= 2)
    found = first_page(found, F.lit(True))
    blocks = passages(docs.select("doc_id", part_section(F.col("text"), part).alias("text"))).where((F.col("last_question") >= low) & (F.col("first_question") <= high) & (F.col("first_question") <= F.col("last_question")))
    at = found.select("doc_id", "number", "page")
    wanted = blocks.select("doc_id", "first_question", "last_question", "passage", F.explode(F.sequence("first_question", "last_question")).alias("number"))
    keys = ["doc_id", "first_question", "last_question", "passage"]
    groups = wanted.join(found, ["doc_id", "number"]).groupBy(*keys).agg(F.array_sort(F.collect_list(_question())).alias("questions"))
    heads = passage_pages(texts).withColumnRenamed("page", "head_page")
    groups = groups.join(heads, ["doc_id", "first_question", "last_question"], "left")
    groups = groups.join(at.select("doc_id", F.col("number").alias("first_question"), F.col("page").alias("first_page")), ["doc_id", "first_question"], "left")
    groups = groups.join(at.select("doc_id", F.col("number").alias("last_question"), F.col("page").alias("last_page")), ["doc_id", "last_question"], "left")
    page = F.coalesce("head_page", "first_page")
    pages = F.coalesce(F.sequence(F.least(page, F.col("last_page")), F.greatest(page, F.col("last_page"))), F.array_compact(F.array(F.coalesce(page, F.col("last_page")))))
    out = groups.select("doc_id", page.alias("page"), pages.alias("pages"), "first_question", "passage", "questions")
    if part == 7:
        out = out.unionByName(_missing_runs(docs, groups, found, low, high))
    if chunk:
        out = out.withColumn("questions", F.filter("questions", lambda q: q["question_number"].between(low, high))).where(F.size("questions") > 0)
    return out


def _missing_runs(docs: DataFrame, groups: DataFrame, found: DataFrame, low: int, high: int) -> DataFrame:
    """Groups of consecutive numbers that are in no passage, as far as the pages have them; a document's numbers are one array."""
    have = groups.select("doc_id", F.transform("questions", lambda q: q["question_number"]).alias("n")).groupBy("doc_id").agg(F.flatten(F.collect_list("n")).alias("have"))
    all_numbers = F.sequence(F.lit(low), F.lit(high))
    rows = docs.select("doc_id").distinct().join(have, "doc_id", "left")
    rows = rows.withColumn("missing", F.array_except(all_numbers, F.coalesce("have", F.array().cast("array<int>"))))
    rows = rows.select("doc_id", F.posexplode("missing").alias("k", "number")).withColumn("run", F.col("number") - F.col("k"))
    first = rows.groupBy("doc_id", "run").agg(F.min("number").alias("first_question"))
    rows = rows.join(found, ["doc_id", "number"]).groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(_question())).alias("questions")).join(first, ["doc_id", "run"])
    at = found.select("doc_id", F.col("number").alias("first_question"), "page")
    rows = rows.join(at, ["doc_id", "first_question"], "left")
    return rows.select("doc_id", "page", F.array_compact(F.array("page")).alias("pages"), "first_question", F.lit(None).cast("string").alias("passage"), "questions")


def document(docs: DataFrame, spans: DataFrame, images: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, part_number, first_question, page, pages, box, passage, transcript, questions): a whole exam from its texts and pages.

    ``docs`` has doc_id, key_text (the listening key) and text (the exam); ``spans``
    and ``images`` are the exam's pages, ``answers`` its reading key. Photo questions
    get their photo's box, listening groups their graphic's, with garbled questions
    replaced by the page's reading; reading groups have the whole page. Pages are
    modelled, and their lines folded, once for all parts; what several parts read is
    written to the session's shared folder.
    """
    heard = written(listening_parts(docs.select("doc_id", F.col("key_text").alias("text"))), "heard")
    model = written(layout.page_model(spans), "pages")
    ranges = [(PART_RANGES[3][0], PART_RANGES[4][1]), *(PART_RANGES[p][:2] for p in (5, 6, 7))]
    found = written(page_questions(model, ranges), "questions")
    read = first_page(found.where("of = 0"), F.lit(True)).select("doc_id", F.col("number").alias("question_number"), F.col("stem").alias("question_text"), "options")
    talks = heard.where("part_number in (3, 4)").withColumnRenamed("stem", "question_text")
    mended = repaired(talks.select("doc_id", "question_number", "question_text", "options"), read).withColumnRenamed("question_text", "stem")
    mended = talks.drop("question_text", "options").join(mended, ["doc_id", "question_number"])
    heard = heard.where("part_number < 3").unionByName(mended)
    keys = ["doc_id", "part_number", "first_question"]
    groups = written(heard.groupBy(*keys).agg(F.max("transcript").alias("transcript"), F.array_sort(F.collect_list(_question("question_number"))).alias("questions")), "groups")
    photos = graphics.photo_boxes(spans).select("doc_id", F.col("number").alias("first_question"), F.lit(1).alias("part_number"), "page", "box")
    starts = groups.where("part_number in (3, 4)").select(*keys).where(F.col("first_question").isin(*(n for p in (3, 4) for n in GRAPHIC_STARTS[p])))
    shown = graphics.graphic_boxes(spans, images, starts.select("doc_id", "first_question", (F.col("first_question") + 2).alias("last_question")), layout.model_lines(model))
    shown = shown.groupBy("doc_id", "first_question").agg(F.min_by(F.struct("page", "box"), "page").alias("s")).select("doc_id", "first_question", "s.page", "s.box").withColumn("part_number", F.when(F.col("first_question") < 71, 3).otherwise(4))
    heard = groups.join(photos.unionByName(shown, allowMissingColumns=True), keys, "left")
    heard = heard.select(*keys, "page", F.array_compact(F.array("page")).alias("pages"), "box", F.lit(None).cast("string").alias("passage"), "transcript", "questions")
    exam = docs.select("doc_id", "text")
    texts = model.select(*layout.PAGE, "page_text")
    of = lambda part: with_letters(found.where(F.col("of") == part - 4), answers)
    reading = [(5, by_page(of(5))), (6, groups_of(exam, texts, of(6), 6)), (7, groups_of(exam, texts, of(7), 7))]
    for part, rows in reading:
        whole = F.struct(*[F.lit(v).alias(k) for k, v in zip("xywh", (0.0, 0.0, 1.0, 1.0), strict=True)])
        heard = heard.unionByName(rows.select("doc_id", F.lit(part).alias("part_number"), "first_question", "page", "pages", whole.cast(heard.schema["box"].dataType).alias("box"), "passage", F.lit(None).cast("string").alias("transcript"), "questions"))
    return heard


def pages_of_numbers(spans: DataFrame, numbers: DataFrame) -> DataFrame:
    """(doc_id, number, page): the first page with the number's anchor, else the first page whose text names it."""
    anchored = layout.anchors(spans).groupBy("doc_id", "number").agg(F.min("page").alias("page"))
    named = spans.select("doc_id", "page", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\d{1,3})\s*\."), F.lit(1))).alias("n"))
    named = named.select("doc_id", F.col("n").cast("int").alias("number"), "page").groupBy("doc_id", "number").agg(F.min("page").alias("text_page"))
    rows = numbers.join(anchored, ["doc_id", "number"], "left").join(named, ["doc_id", "number"], "left")
    return rows.select("doc_id", "number", F.coalesce("page", "text_page").alias("page"))


def with_graphics(groups: DataFrame, graphics: DataFrame, starts: list[int]) -> DataFrame:
    """Groups (doc_id, part_number, first_question) with the graphic of theirs, only where a group may have one."""
    eligible = F.col("first_question").isin(*starts)
    rows = groups.join(graphics.select("doc_id", "first_question", F.col("box").alias("_box")), ["doc_id", "first_question"], "left")
    return rows.withColumn("box", F.when(eligible, F.col("_box"))).drop("_box")


def asset_plan(groups: DataFrame) -> DataFrame:
    """(doc_id, page, crop, groups): the renders a document needs; reading pages are shared by their groups, part 5 needs none.

    ``groups`` has doc_id, part_number, group_no, page and box (null: whole page).
    """
    needed = groups.where("part_number <> 5 and page is not null")
    crop = F.when((F.col("part_number") >= 6) | F.col("box").isNull(), F.lit(None)).otherwise(F.to_json("box"))
    return needed.withColumn("crop", crop).groupBy("doc_id", "page", "crop").agg(F.array_sort(F.collect_list(F.concat_ws("-", F.col("part_number").cast("string"), F.col("group_no").cast("string")))).alias("groups"))


def graphic_listing(tests: DataFrame, parts: DataFrame, questions: DataFrame, groups: DataFrame) -> DataFrame:
    """(test_id, part_number, question_number, image): listening questions that ask to look at a graphic, in order of their numbers.

    ``parts`` has part_id, test_id and part_number, ``questions`` part_id, group_id, question_number and
    question_text, ``groups`` group_id and image; a question may have no group. Tests are few and reach the tasks
    as a broadcast if Spark finds them small.
    """
    heard = parts.where(F.col("part_number").isin(3, 4)).join(tests.select("test_id"), "test_id")
    asked = questions.where(F.col("question_text").rlike("(?i)look at the graphic"))
    rows = asked.join(heard, "part_id").join(groups.select("group_id", "image"), "group_id", "left")
    return rows.select("test_id", "part_number", "question_number", "image").orderBy("test_id", "question_number")


def numbers_between(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, number): every number from the least to the largest of each key."""
    ends = rows.groupBy(*keys).agg(F.min(number).alias("_a"), F.max(number).alias("_b"))
    return ends.select(*keys, F.explode(F.sequence("_a", "_b")).alias(number))

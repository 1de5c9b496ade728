"""Page layout: columns, anchors, lines and word regions of positioned spans.

Spans are rows (doc_id, page, idx, text, x, y, w, h) with coordinates in 0..1.
"""

from __future__ import annotations

import itertools
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.model import LINE_TOLERANCE, PART_RANGES

PAGE = ["doc_id", "page"]
#: Rows whose spans are Python values at once; bounds a task's memory.
ROWS_AT_ONCE = 64


# White space of any kind around the number counts as trimmed.
_LABEL = r"^(?U:[\s\uFEFF]*)(\d{1,3})\s*\.(?:\s|(?U:[\s\uFEFF]*)$)"


def question_number(c):
    """The number of ``n.`` or ``n. text``; null otherwise."""
    return F.when(c.rlike(_LABEL), F.regexp_extract(c, _LABEL, 1).cast("int"))  # a failing try_cast costs an exception for each span


def page_columns(spans: DataFrame) -> DataFrame:
    """(doc_id, page, dual, split_x): a page has two columns when question labels stand on both halves."""
    labelled = spans.withColumn("_x", F.when(question_number(F.col("text")).isNotNull(), F.col("x")))
    pages = labelled.groupBy(*PAGE).agg(F.count_if(F.col("_x") < 0.5).alias("l"), F.count_if(F.col("_x") >= 0.5).alias("r"), F.min(F.when(F.col("_x") >= 0.5, F.col("_x"))).alias("right"))
    dual = (F.col("l") >= 1) & (F.col("r") >= 1)
    return pages.select(*PAGE, dual.alias("dual"), F.when(dual, F.greatest(F.lit(0.45), F.col("right") - 0.02)).otherwise(0.5).alias("split_x"))


def with_column(spans: DataFrame) -> DataFrame:
    """Spans with dual, split_x and the column that they stand in: single, left or right; one window over the page."""
    page = Window.partitionBy(*PAGE)
    x = F.when(question_number(F.col("text")).isNotNull(), F.col("x"))
    rows = spans.withColumn("_x", x).withColumn("dual", (F.count_if(F.col("_x") < 0.5).over(page) >= 1) & (F.count_if(F.col("_x") >= 0.5).over(page) >= 1))
    right = F.min(F.when(F.col("_x") >= 0.5, F.col("_x"))).over(page)
    rows = rows.withColumn("split_x", F.when(F.col("dual"), F.greatest(F.lit(0.45), right - 0.02)).otherwise(0.5)).drop("_x")
    return rows.withColumn("column", F.when(~F.col("dual"), "single").when(F.col("x") < F.col("split_x"), "left").otherwise("right"))


def reading_order(spans: DataFrame) -> DataFrame:
    """Spans with their place: left or single column first, then y, then x."""
    rank = F.when(F.col("column") == "right", 1).otherwise(0)
    return with_column(spans).withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(rank, "y", "x", "idx")))


def anchors(spans: DataFrame) -> DataFrame:
    """Question labels with the y where the next question of their column begins."""
    rows = with_column(spans).withColumn("number", question_number(F.col("text"))).where("number is not null")
    order = Window.partitionBy(*PAGE, "column").orderBy("y", "x", "idx")
    return rows.select(*PAGE, "column", "number", "x", "y", F.lead("y").over(order).alias("next_y"))


def near_median(found: DataFrame, reach: float = 0.05, single: bool = True) -> DataFrame:
    """Anchors within ``reach`` of their column's median x; a lone anchor stays, and without ``single`` all of a page with one column."""
    column = Window.partitionBy(*PAGE, "column")
    rows = found.withColumn("_mid", F.median("x").over(column)).withColumn("_n", F.count("*").over(column))
    kept = F.lit(False) if single else F.col("column") == "single"
    return rows.where(kept | (F.col("_n") < 2) | (F.abs(F.col("x") - F.col("_mid")) <= reach)).drop("_mid", "_n")


_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACES = re.compile(f"[{_SPACE}]+")
_LETTERS, _DIGITS = frozenset(string.ascii_letters), frozenset(string.digits)


def joined_line(parts: list[tuple]) -> str:
    """Text of one line from (x, w, text), ordered: tight digits, single letters and punctuation join without a space."""
    line, end, before = "", 0.0, None
    for x, w, text in parts:
        t = (text or "").strip(_SPACE)
        if before is None:
            line = t
        elif t:
            close = t[0] in ",.;:!?)" or line.endswith("(")
            if not close and before and x is not None and end is not None and x - end <= 0.004:
                close = before in _LETTERS or (before[-1] in _DIGITS and t[0] in _DIGITS)
            if not close and t in _LETTERS and x is not None and end is not None:
                close = x - end <= 0.004
            line += t if close else " " + t
        end, before = (None if x is None or w is None else x + w), t
    return _SPACES.sub(" ", line).strip(_SPACE)


def joined(parts: Column) -> Column:
    """``joined_line`` of an array of (x, w, text)."""
    fields = F.transform(parts, lambda z: F.struct(z["x"].alias("x"), z["w"].alias("w"), z["text"].alias("text")))
    return F.udf(lambda rows: joined_line([(r["x"], r["w"], r["text"]) for r in rows]), "string")(fields)


def _nulls_first(values: tuple) -> list:
    """A sort key as Spark's: nulls first, NaN last."""
    return [(v is not None, v == v, v if v is not None and v == v else 0) for v in values]


def folded_lines(spans: list[tuple]) -> list[dict]:
    """Lines (y, x, bottom, line) of spans (y, x, w, h, text): those within the tolerance of a line's first y, in order of y, then x."""
    clean = all(v is not None and v == v for span in spans for v in span[:4])
    out, head, group = [], None, []
    for span in sorted(spans) if clean else sorted(spans, key=_nulls_first):
        if head is None or span[0] is None or not abs(span[0] - head) <= LINE_TOLERANCE:
            group = []
            out.append(group)
            head = span[0]
        group.append(span)
    return [_line(group, clean) for group in out]


def _line(group: list[tuple], clean: bool) -> dict:
    ordered = sorted(group, key=(lambda z: z[1]) if clean else (lambda z: _nulls_first((z[1],))))
    xs = [z[1] for z in ordered if z[1] is not None]
    bottoms = [z[0] + z[3] for z in group if z[0] is not None and z[3] is not None]
    return {"y": group[0][0], "x": xs[0] if xs else None, "bottom": max(bottoms, default=None), "line": joined_line([(z[1], z[2], z[4]) for z in ordered])}


LINE = "struct<y:double,x:double,bottom:double,line:string>"


_LINES = pa.list_(pa.list_(pa.struct([("y", pa.float64()), ("x", pa.float64()), ("bottom", pa.float64()), ("line", pa.string())])))


def _lines_of(arrays: pa.Array) -> pa.Array:
    """The lines of arrays of arrays of spans; a slice of rows at a time becomes numpy or Python values."""
    done = [pa.array([], _LINES)]
    for at in range(0, len(arrays), ROWS_AT_ONCE):
        rows = arrays.slice(at, ROWS_AT_ONCE)
        inner = rows.flatten()
        spans = inner.flatten()
        sizes = pc.fill_null(inner.value_lengths(), 0).to_numpy(zero_copy_only=False)
        found = _lines_by_columns(spans, sizes)
        done.append(_lines_by_values(rows, spans, sizes) if found is None else _nested(rows, *found))
    return pa.concat_arrays(done)


def _lines_by_values(rows: pa.Array, spans: pa.Array, sizes: np.ndarray) -> pa.Array:
    """``folded_lines`` of each array of spans, whatever they hold."""
    values = list(zip(*(spans.field(n).to_pylist() for n in ("y", "x", "w", "h", "text")), strict=True))
    folded = iter([folded_lines(values[a:b]) for a, b in itertools.pairwise([0, *itertools.accumulate(sizes.tolist())])])
    return pa.array([None if n is None else list(itertools.islice(folded, n)) for n in rows.value_lengths().to_pylist()], _LINES)


def _lines_by_columns(spans: pa.Array, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray] | None:
    """(lines, how many each array of spans has), as ``folded_lines`` has them; only lines of several spans become Python values.

    None where that takes more than finite numbers: for missing ones, for spans in one place, which their texts order, and without any.
    """
    y, x, w, h = (spans.field(n).to_numpy(zero_copy_only=False) for n in ("y", "x", "w", "h"))
    if not len(y) or not all(np.isfinite(v).all() for v in (y, x, w, h)) or spans.field("text").null_count:
        return None
    of = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((h, w, x, y, of))
    y, x, w, h, of = (v[order] for v in (y, x, w, h, of))
    same = of[1:] == of[:-1]
    if (same & (y[1:] == y[:-1]) & (x[1:] == x[:-1]) & (w[1:] == w[:-1]) & (h[1:] == h[:-1])).any():
        return None
    # A gap beyond the tolerance begins a line in any case; between gaps it counts from the line's head.
    begins = np.ones(len(y), bool)
    begins[1:] = ~(same & (y[1:] - y[:-1] <= LINE_TOLERANCE))
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(y))
    long = ~(y[ends - 1] - y[starts] <= LINE_TOLERANCE)
    for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        head, *rest = y[a:b].tolist()
        for i, here in enumerate(rest, a + 1):
            if not here - head <= LINE_TOLERANCE:
                begins[i], head = True, here
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(y))
    texts = spans.field("text").take(pa.array(order))
    xs, bottoms = x[starts], y[starts] + h[starts]
    said = pc.replace_substring_regex(pc.utf8_trim(texts.take(pa.array(starts)), _SPACE), f"[{_SPACE}]+", " ")
    several = np.flatnonzero(ends - starts > 1)
    if len(several):
        said, values = said.to_pylist(), list(zip(y.tolist(), x.tolist(), w.tolist(), h.tolist(), texts.to_pylist(), strict=True))
        for k, a, b in zip(several.tolist(), starts[several].tolist(), ends[several].tolist(), strict=True):
            line = _line(values[a:b], True)
            xs[k], bottoms[k], said[k] = line["x"], line["bottom"], line["line"]
    columns = {"y": y[starts], "x": xs, "bottom": bottoms, "line": pa.array(said, pa.string())}
    return pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], list(columns)), np.bincount(of[starts], minlength=len(sizes))


def _nested(rows: pa.Array, lines: pa.Array, counts: np.ndarray) -> pa.Array:
    """Lines as arrays of arrays, in as many arrays a row as ``rows`` has; null where that is null."""
    ends = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
    inner = pa.ListArray.from_arrays(ends(counts), lines)
    return pa.ListArray.from_arrays(ends(pc.fill_null(rows.value_lengths(), 0).to_numpy(zero_copy_only=False)), inner, mask=rows.is_null()).cast(_LINES)


def lines_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, y, x, bottom, line): spans within the tolerance of a line's first y form the line.

    The tolerance counts from the line's head, so this is a fold over the spans of
    each key in order of y, then x; rows need y, x, w, h and text.
    """
    spans = rows.groupBy(*keys).agg(F.collect_list(F.struct("y", "x", "w", "h", "text")).alias("spans"))
    found = with_lines(spans, F.array("spans"), "_lines")
    return found.select(*keys, F.posexplode(F.get("_lines", F.lit(0))).alias("line_no", "l")).select(*keys, "line_no", "l.*")


def lines(spans: DataFrame) -> DataFrame:
    """(doc_id, page, column, y, x, bottom, line): the lines of each column of each page, folded on the page's row."""
    return model_lines(_with_page_lines(_paged(spans)))


def outside(spans: DataFrame, boxes: DataFrame, margin: float = 0.004) -> DataFrame:
    """Spans whose centre is in none of the boxes (doc_id, page, x, y, w, h) of their page, grown by ``margin``."""
    of_page = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct("x", "y", "w", "h")).alias("_boxes"))
    span = F.struct("x", "y", "w", "h")
    rows = spans.join(of_page, PAGE, "left")
    return rows.where(F.col("_boxes").isNull() | ~F.exists("_boxes", lambda b: covers(b, span, margin))).drop("_boxes")


def covers(box: Column, span: Column, margin: float = 0.004) -> Column:
    """Whether a span's centre is in a box grown by ``margin``."""
    cx, cy = span["x"] + span["w"] / 2, span["y"] + span["h"] / 2
    return cx.between(box["x"] - margin, box["x"] + box["w"] + margin) & cy.between(box["y"] - margin, box["y"] + box["h"] + margin)


def band(spans: DataFrame, found: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """Spans of each question: middle y from its label up to the next label of its column, without those in excluded boxes.

    A page's anchors are an array that its spans meet by an equality join on the page.
    """
    of_page = found.groupBy(*PAGE).agg(F.collect_list(F.struct("column", "number", "y", "next_y")).alias("_anchors"))
    s = with_column(spans)
    s = (outside(s, exclude) if exclude is not None else s).withColumn("mid", F.col("y") + F.col("h") / 2)
    inside = lambda a: (a["column"] == F.col("column")) & (F.col("mid") >= a["y"] - 0.008) & (a["next_y"].isNull() | (F.col("mid") < a["next_y"] + 0.008))
    rows = s.join(of_page, PAGE).withColumn("_a", F.explode(F.filter("_anchors", inside)))
    return rows.select(*PAGE, F.col("_a.number").alias("number"), "idx", "text", "x", "y", "w", "h")


def page_texts(spans: DataFrame) -> DataFrame:
    """(doc_id, page, page_text): the spans' texts in their order, a line each."""
    texts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return spans.groupBy(*PAGE).agg(F.array_join(F.transform(texts, lambda t: t["text"]), "\n").alias("page_text"))


def with_lines(rows: DataFrame, source: Column, into: str) -> DataFrame:
    """``rows`` with the lines (y, x, bottom, line) of several arrays of spans: an array of arrays, as ``source`` is.

    The same lines as ``lines_by`` has, without leaving the row: ``folded_lines`` goes over
    each array once. Array functions did that several times over, for each line anew.
    """
    fields = lambda z: F.struct(*(z[n].cast("double").alias(n) for n in "yxwh"), F.coalesce(z["text"], F.lit("")).alias("text"))
    return settled(settled(rows, _spans_of=F.transform(source, lambda spans: F.transform(spans, fields))), **{into: F.arrow_udf(_lines_of, f"array<array<{LINE}>>")("_spans_of")}).drop("_spans_of")


def settled(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns that are computed once a row, also where a function of array elements reads them.

    A plain column would be merged into such a function and computed for every element.
    """
    return rows.select(*[c for c in rows.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _paged(spans: DataFrame, fields: tuple[str, ...] = ("idx", "text", "x", "y", "w", "h")) -> DataFrame:
    """(doc_id, page, dual, split_x, spans): a page's spans in its order, each with its number and column; one shuffle, of ``fields`` only (x among them)."""
    row = F.struct(*fields, question_number(F.col("text")).alias("number"))
    return _with_columns(spans.select(*PAGE, row.alias("s")).groupBy(*PAGE).agg(F.sort_array(F.collect_list("s")).alias("s")))


def _with_columns(pages: DataFrame) -> DataFrame:
    """Pages with dual, split_x and ``spans``, each with its column, in place of ``s``, spans with their numbers."""
    label_x = F.transform(F.filter("s", lambda z: z["number"].isNotNull()), lambda z: z["x"])
    pages = settled(pages, _x=label_x)
    pages = pages.withColumn("_left", F.exists("_x", lambda x: F.coalesce(x < 0.5, F.lit(False)))).withColumn("_right", F.array_min(F.filter("_x", lambda x: x >= 0.5)))
    dual = F.col("_left") & F.col("_right").isNotNull()
    pages = settled(pages, dual=dual, split_x=F.when(dual, F.greatest(F.lit(0.45), F.col("_right") - 0.02)).otherwise(0.5))
    return settled(pages, spans=F.transform("s", lambda z: z.withField("column", _column_at(z["x"])))).drop("s", "_x", "_left", "_right")


def _with_page_lines(pages: DataFrame) -> DataFrame:
    """``_paged`` pages with ``lines``: each column's lines (column, y, x, bottom, line)."""
    sides = F.array(F.filter("spans", lambda z: z["column"] != "right"), F.filter("spans", lambda z: z["column"] == "right"))
    pages = with_lines(pages, sides, "_lines")
    named = lambda side, column: F.transform(F.get("_lines", F.lit(side)), lambda z: F.struct(column.alias("column"), *(z[n].alias(n) for n in ("y", "x", "bottom", "line"))))
    return settled(pages, lines=F.concat(named(0, F.when(F.col("dual"), "left").otherwise("single")), named(1, F.lit("right")))).drop("_lines")


def page_model(spans: DataFrame) -> DataFrame:
    """(doc_id, page, dual, split_x, spans, lines, page_text): a row per page, built in one shuffle.

    ``spans`` is an array in the page's order with each span's number (if it is a
    question label) and column; ``lines`` has each column's lines (column, y, x, bottom, line).
    """
    return _with_page_text(_with_page_lines(_paged(spans)))


def _with_page_text(pages: DataFrame) -> DataFrame:
    return settled(pages, page_text=F.array_join(F.transform("spans", lambda z: z["text"]), "\n"))


def label_bands(spans: DataFrame, fields: tuple[str, ...] = ("idx", "text", "x", "y", "w", "h")) -> DataFrame:
    """(doc_id, page, number, fields): ``band`` of ``anchors``, on a page's row, so that spans are shuffled once and nothing is joined.

    Fields that are not asked for are not shuffled, except those that bands need.
    """
    pages = _paged(spans, tuple(dict.fromkeys(["idx", *fields, "x", "y", "h"])))
    labels = F.transform(F.filter("spans", lambda z: z["number"].isNotNull()), lambda z: F.struct(*(z[n].alias(n) for n in ("column", "y", "x", "idx", "number"))))
    pages = settled(pages, _labels=F.array_sort(labels))
    behind = lambda i: F.get("_labels", i + 1)
    anchors = F.transform("_labels", lambda z, i: z.withField("next_y", F.when(behind(i)["column"] == z["column"], behind(i)["y"])))
    rows = pages.select(*PAGE, "spans", F.explode(anchors).alias("a"))
    rows = rows.select(*PAGE, F.col("a.number").alias("number"), F.explode(F.filter("spans", lambda s: in_band(s, F.col("a")))).alias("s"))
    return rows.select(*PAGE, "number", *(F.col(f"s.{n}").alias(n) for n in fields))


def _column_at(x: Column) -> Column:
    return F.when(~F.col("dual"), "single").when(x < F.col("split_x"), "left").otherwise("right")


def model_lines(model: DataFrame) -> DataFrame:
    """(doc_id, page, column, y, x, bottom, line) of a page model: the rows of ``lines``."""
    return model.select(*PAGE, F.explode("lines").alias("l")).select(*PAGE, "l.*")


def with_anchors(model: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """A page model with ``anchors``: (of, column, number, x, y, next_y), one for each question number of a page.

    ``ranges`` of numbers, which ``of`` counts from 0, do not see each other: every
    range has its own medians and next questions. Candidates are span labels, lines
    that start with a label, labels of 100 and more inside lines, and, for numbers
    that have none of these, the span that holds the first words behind the number in
    the page's text; a number inside a decimal or an address is none. The best counts: 2 for a bare label at its place, 4 for an
    option (A) within 0.08 below in its column, and its y; of equals the first.
    Anchors far from their column's median x go.
    """

    def of(number: Column) -> Column:
        out = F.lit(None).cast("int")
        for k, (first, last) in enumerate(ranges):
            out = F.when(number.between(first, last) & out.isNull(), k).otherwise(out)
        return out

    def candidate(number: Column, x: Column, y: Column, kind: int, at: Column) -> Column:
        return F.struct(number.alias("number"), x.alias("x"), y.alias("y"), F.lit(kind).alias("kind"), at.cast("double").alias("at"))

    known = lambda z: z["number"].isNotNull() & of(z["number"]).isNotNull()
    labels = F.transform(F.filter("spans", lambda z: z["number"].isNotNull()), lambda z: candidate(z["number"], z["x"], z["y"], 0, z["idx"]))
    model_columns = model.columns
    model = settled(model, _dotted=F.filter("lines", lambda z: z["line"].contains(".")))  # only these can hold a label
    starts = F.transform("_dotted", lambda z: candidate(question_number(z["line"]), z["x"], z["y"], 1, z["y"]))
    inner = lambda z: F.filter(F.transform(F.regexp_extract_all(z["line"], F.lit(r"(?:^|\s)(\d{1,3})\s*\.(?!\d)"), F.lit(1)), lambda n: n.cast("int")), lambda n: n >= 100)
    inline = F.flatten(F.transform("_dotted", lambda z: F.transform(inner(z), lambda n: candidate(n, z["x"], z["y"], 1, z["y"]))))
    rows = settled(model, _found=F.filter(F.concat(labels, starts, inline), known))
    # Numbers without an anchor: the first span with the first three words behind ``n.`` in the page's text.
    pattern = r"(\d{1,3})\.(?!\d)\s*([^\n]{4,120})"
    found = F.regexp_extract_all("page_text", F.lit(r"(?=\d)(?<![\d.])\b" + pattern), F.lit(0))
    named = F.transform(found, lambda m: F.struct(F.regexp_extract(m, "^" + pattern, 1).cast("int").alias("number"), m.alias("said")))
    rows = settled(rows, _named=F.filter(named, known), _have=F.transform("_found", lambda z: z["number"]))
    rows = settled(rows, _order=F.transform("_named", lambda z: z["number"]))
    first = F.filter("_named", lambda z, i: (F.array_position("_order", z["number"]) == i + 1) & ~F.array_contains("_have", z["number"]))
    hint = lambda said: F.array_join(F.slice(F.split(F.substring(T.trim(T.dashes_to_spaces(said)), 1, 30), r"\s+"), 1, 3), " ")
    rows = rows.withColumn("_named", F.filter(F.transform(first, lambda z: F.struct(z["number"].alias("number"), hint(F.regexp_extract(z["said"], "^" + pattern, 2)).alias("words"))), lambda z: F.length(z["words"]) >= 4))
    said = F.transform("_named", lambda z: F.struct(z["number"].alias("number"), F.get(F.filter("spans", lambda s: s["text"].contains(z["words"])), F.lit(0)).alias("s")))
    said = F.transform(F.filter(said, lambda z: z["s"].isNotNull()), lambda z: candidate(z["number"], z["s"]["x"], z["s"]["y"], 2, F.lit(0.0)))
    rows = settled(rows, _bare=F.filter("spans", lambda z: z["number"].isNotNull() & T.trim(z["text"]).rlike(r"^\d{1,3}\s*\.$")), _options=F.filter("lines", lambda z: z["line"].rlike(r"(?i)\(A\)")))
    is_bare = lambda z: F.exists("_bare", lambda b: (b["x"] == z["x"]) & (F.abs(b["y"] - z["y"]) < 0.01))
    has_options = lambda z: F.exists("_options", lambda o: (o["column"] == _column_at(z["x"])) & o["y"].between(z["y"] - 0.01, z["y"] + 0.08))
    score = lambda z: F.when(is_bare(z), 2).otherwise(0) + F.when(has_options(z), 4).otherwise(0) + z["y"]
    ranked = F.transform(F.concat("_found", said), lambda z: F.struct(z["number"].alias("number"), (-score(z)).alias("score"), z["kind"].alias("kind"), z["at"].alias("at"), _column_at(z["x"]).alias("column"), z["x"].alias("x"), z["y"].alias("y")))
    rows = settled(rows, _ranked=F.sort_array(ranked))
    best = F.filter("_ranked", lambda z, i: (i == 0) | (F.get("_ranked", i - 1)["number"] != z["number"]))
    rows = settled(rows, _best=F.transform(best, lambda z: F.struct(of(z["number"]).alias("of"), *(z[n].alias(n) for n in ("column", "y", "x", "number")))))
    alike = lambda z: F.array_sort(F.transform(F.filter("_best", lambda o: (o["of"] == z["of"]) & (o["column"] == z["column"])), lambda o: o["x"]))
    rows = settled(rows, _best=F.transform("_best", lambda z: z.withField("xs", alike(z))))
    middle = lambda xs: (F.get(xs, F.floor((F.size(xs) - 1) / 2).cast("int")) + F.get(xs, F.floor(F.size(xs) / 2).cast("int"))) / 2
    near = F.filter("_best", lambda z: (z["column"] == "single") | (F.size(z["xs"]) < 2) | (F.abs(z["x"] - middle(z["xs"])) <= 0.05))
    rows = settled(rows, _kept=F.sort_array(F.transform(near, lambda z: z.dropFields("xs"))))
    behind = lambda z, i: F.get("_kept", i + 1)
    next_y = lambda z, i: F.when((behind(z, i)["of"] == z["of"]) & (behind(z, i)["column"] == z["column"]), behind(z, i)["y"])
    return settled(rows.select(*model_columns, "_kept"), anchors=F.transform("_kept", lambda z, i: z.withField("next_y", next_y(z, i)))).drop("_kept")


def question_anchors(spans: DataFrame, first: int = 1, last: int = 999, texts: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, column, number, x, y, next_y): the anchors of ``with_anchors``, a row each.

    ``texts`` (doc_id, page, page_text) are the pages' texts, if they are not those of the spans.
    """
    model = page_model(spans)
    if texts is not None:
        model = model.drop("page_text").join(texts.select(*PAGE, "page_text"), PAGE, "left")
    found = with_anchors(model, [(first, last)])
    return found.select(*PAGE, F.explode("anchors").alias("a")).select(*PAGE, *(F.col(f"a.{n}").alias(n) for n in ("column", "number", "x", "y", "next_y")))


def in_band(span: Column, anchor: Column) -> Column:
    """Whether a span's middle lies between an anchor and the next of its column."""
    middle = span["y"] + span["h"] / 2
    return (span["column"] == anchor["column"]) & (middle >= anchor["y"] - 0.008) & (anchor["next_y"].isNull() | (middle < anchor["next_y"] + 0.008))


def pages_of_range(anchored: DataFrame, first: int, last: int) -> DataFrame:
    """(doc_id, page): the pages with an anchor of the range."""
    return anchored.where(F.col("number").between(first, last)).select(*PAGE).distinct()


def pages_of_part(model: DataFrame, part: int) -> DataFrame:
    """(doc_id, page): pages of a page model from a part's header on, up to the next part's header on a later page.

    A document without the header has the pages with an anchor of the part's questions.
    """
    first, last, _ = PART_RANGES[part]
    rows = _with_bounds(with_anchors(model, [(first, last)]).select(*PAGE, "page_text", (F.size("anchors") > 0).alias("_asked")), part)
    return rows.where(F.when(F.col("_start").isNull(), F.col("_asked")).otherwise(_in_bounds())).select(*PAGE)


def _with_bounds(pages: DataFrame, part: int) -> DataFrame:
    """Pages with the first page with a part's header (``_start``) and the first later one with the next part's (``_stop``), in place of page_text."""
    named = lambda n: F.col("page_text").rlike(rf"(?i)\bPART\s*{n}\b")
    of_doc = Window.partitionBy("doc_id")
    rows = pages.withColumns({"_here": named(part), "_next": named(part + 1)}).drop("page_text")
    rows = rows.withColumn("_start", F.min(F.when(F.col("_here"), F.col("page"))).over(of_doc))
    stop = F.min(F.when(F.col("_next") & (F.col("page") > F.col("_start")), F.col("page"))).over(of_doc) if part < 7 else F.lit(None).cast("int")
    return rows.withColumn("_stop", stop).drop("_here", "_next")


def _in_bounds() -> Column:
    return (F.col("page") >= F.col("_start")) & (F.col("_stop").isNull() | (F.col("page") < F.col("_stop")))


def section_texts(pages: DataFrame, part: int, chunk: tuple[int, int] | None = None, spans: Column | None = None) -> DataFrame:
    """(doc_id, text): a part's pages as text in reading order, a blank line between pages; from a passage's header on, if ``chunk`` names one that is there.

    ``pages`` has a row per page: a page model, or (doc_id, page, page_text) and whatever
    ``spans`` needs, the column of a page's spans. That is computed for the pages from the
    part's header on, and for all of a document without it; only the latter's are
    searched for anchors. Nothing is joined; where pages lie by doc_id, only the texts of the part's pages are shuffled.
    """
    first, last, _ = PART_RANGES[part]
    rows = _with_bounds(pages.where("doc_id IS NOT NULL AND page IS NOT NULL").drop("dual", "split_x", "lines"), part)
    rows = rows.where(F.col("_start").isNull() | _in_bounds())
    span = lambda z: F.struct(*(z[n].alias(n) for n in ("idx", "text", "x", "y", "w", "h")), question_number(z["text"]).alias("number"))
    rows = _with_columns(rows.select(*PAGE, F.col("_start").isNotNull().alias("_headed"), F.sort_array(F.transform(F.col("spans") if spans is None else spans, span)).alias("s")))
    order = F.sort_array(F.transform("spans", lambda z: F.struct((z["column"] == "right").alias("right"), z["y"].alias("y"), z["x"].alias("x"), z["idx"].alias("idx"), z["text"].alias("text"))))
    rows = settled(rows, said=F.array_join(F.transform(order, lambda z: z["text"]), " "), spans=F.when(F.col("_headed"), F.slice("spans", 1, 0)).otherwise(F.col("spans")))
    rows = with_anchors(_with_page_text(_with_page_lines(rows)), [(first, last)]).where(F.col("_headed") | (F.size("anchors") > 0))
    rows = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "said"))), lambda z: z["said"]), "\n\n").alias("text"))
    if chunk:
        at = F.regexp_instr("text", F.lit(rf"(?i)Questions?\s+{chunk[0]}\s*-\s*{chunk[1]}\s+refer"))
        rows = rows.withColumn("text", F.when(at > 0, F.substr("text", at)).otherwise(F.col("text")))
    return rows


def word_regions(spans: DataFrame) -> DataFrame:
    """(doc_id, page, idx, word_no, word, x, y, w, h): words of each span, their boxes by share of characters."""
    words = spans.select("doc_id", "page", "idx", "x", "y", "w", "h", F.col("text"), F.posexplode(F.split("text", " ")).alias("word_no", "raw"))
    order = Window.partitionBy("doc_id", "page", "idx").orderBy("word_no")
    before = F.sum(F.length("raw") + 1).over(order) - F.length("raw") - 1
    rows = words.withColumn("at", before / F.length("text")).withColumn("share", F.length("raw") / F.length("text")).withColumn("word", T.strip_punctuation(F.col("raw")))
    return rows.where(T.is_word(F.col("word"))).select(
        "doc_id", "page", "idx", "word_no", "word", (F.col("x") + F.col("w") * F.col("at")).alias("x"), "y", F.greatest(F.lit(0.005), F.col("w") * F.col("share")).alias("w"), "h",
    )


def bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box around the boxes of each key; boxes that end up tiny are dropped."""
    box = rows.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x2"), F.max(F.col("y") + F.col("h")).alias("y2"))
    box = box.select(*keys, "x", "y", (F.col("x2") - F.col("x")).alias("w"), (F.col("y2") - F.col("y")).alias("h"))
    return box.where("w >= 0.02 and h >= 0.02")

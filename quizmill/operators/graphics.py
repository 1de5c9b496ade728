"""Boxes of photos, passages and graphics on a page, from spans (see ``layout``) and image rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.functions.numbers import clamped_box
from quizmill.operators import layout

# Pages of the photo part's questions, the photo's left edge and width, margins, half-page bands
# (around a divider in the middle, not where labels split the page), and how far a picture is grown and cut.
PHOTO_PAGES = {1: 2, 2: 2, 3: 3, 4: 3, 5: 4, 6: 4}
PHOTO_LEFT, PHOTO_WIDTH, PHOTO_LOWEST = 0.08, 0.84, 0.92
DIVIDER = 0.5
LEFT_BAND, RIGHT_BAND = (0.05, 0.485), (0.515, 0.96)
ABOVE_QUESTION, BELOW_CONTENT, BELOW_GROUP = 0.015, 0.008, 0.12
PAGE_TOP, MOST_HEIGHT, LEAST_IMAGE = 0.04, 0.34, 0.03
SAME_ROW, CUE_ABOVE, CUE_BELOW, CUE_BEHIND = 0.014, 0.05, 0.35, 0.15
IMAGE_EDGE = (0.04, 0.03, 0.96, 0.92, 0.01)
CUE_EDGE = (0.05, 0.04, 0.95, 0.9, 0.02)
CUES = r"(?i)graphic|chart|table|schedule|notice|e-mail|email|form"

PAGE = layout.PAGE


def photo_boxes(spans: DataFrame) -> DataFrame:
    """(doc_id, page, number, box) of the photo questions.

    An odd question's photo ends above its partner's label; an even one has no
    label below and takes the odd one's height.
    """
    pages = F.create_map(*[F.lit(x) for pair in PHOTO_PAGES.items() for x in pair])
    number = F.regexp_extract(T.trim(F.col("text")), r"^([1-6])\.$", 1)
    labels = spans.where(number != "").select("doc_id", "page", "idx", "y", number.try_cast("int").alias("number")).where(F.col("page") == pages[F.col("number")])
    labels = labels.groupBy("doc_id", "page", "number").agg(F.min_by("y", "idx").alias("y"))
    partner = labels.select("doc_id", "page", F.when(F.col("number") % 2 == 1, F.col("number") + 1).otherwise(F.col("number") - 1).alias("number"), F.col("y").alias("other"))
    rows = labels.join(partner, ["doc_id", "page", "number"], "left").withColumn("top", F.greatest(F.lit(PAGE_TOP), F.col("y") + 0.02))
    mirrored = F.col("y") - 0.01 - (F.col("other") + 0.02)
    bottom = F.when(F.col("number") % 2 == 1, F.coalesce(F.col("other") - 0.01, F.lit(PHOTO_LOWEST))).otherwise(F.coalesce(F.when(mirrored > 0.02, F.col("top") + mirrored), F.lit(PHOTO_LOWEST)))
    return rows.select("doc_id", "page", "number", clamped_box(F.lit(PHOTO_LEFT), F.col("top"), F.lit(PHOTO_WIDTH), bottom - F.col("top")).alias("box")).where("box is not null")


def _listed(*, by: tuple[str, ...] = ("idx", "x", "y", "w", "h"), where: Column | None = None) -> Column:
    """The columns ``by`` of a group's rows as an array, of those that ``where`` holds for."""
    row = F.struct(*by)
    return F.collect_list(row if where is None else F.when(where, row))


def _bounds_of(boxes: Column) -> Column:
    """(x, y, x2, y2): the smallest box around an array of boxes, in one pass; null without any."""
    none = F.lit(None).cast("double")
    start = F.struct(*(none.alias(n) for n in ("x", "y", "x2", "y2")))
    return F.aggregate(boxes, start, lambda b, z: F.struct(F.least(b["x"], z["x"]).alias("x"), F.least(b["y"], z["y"]).alias("y"), F.greatest(b["x2"], z["x"] + z["w"]).alias("x2"), F.greatest(b["y2"], z["y"] + z["h"]).alias("y2")))


def _box_of(bounds: Column, name: str) -> Column:
    """A box (x, y, w, h) of ``_bounds_of``; null if it is tiny, as in ``layout.bounds``."""
    w, h = bounds["x2"] - bounds["x"], bounds["y2"] - bounds["y"]
    return F.when((w >= 0.02) & (h >= 0.02), F.struct(bounds["x"].alias("x"), bounds["y"].alias("y"), w.alias("w"), h.alias("h"))).alias(name)


def passage_boxes(spans: DataFrame) -> DataFrame:
    """(doc_id, page, first_question, last_question, box): text between a passage's header and the options of its first question.

    A page's headers, first options and English spans are arrays on its row: one
    shuffle, without texts, and nothing is joined or sent to all tasks.
    """
    header, begins = r"(?i)Questions?\s+(\d{1,3})\s*-\s*(\d{1,3})", r"(?i)(\d{1,3})\.\s*\(A\)"
    number = lambda pattern, k: F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, k).cast("int"))
    english = (F.length(T.trim(F.col("text"))) >= 2) & (T.letter_count(F.col("text")) >= F.length(T.trim(F.col("text"))) * 0.4)
    rows = spans.select(*PAGE, "idx", "x", "y", "w", "h", number(header, 1).alias("first_question"), number(header, 2).alias("last_question"), number(begins, 1).alias("begun"), english.alias("english"), (F.col("y") + F.col("h")).alias("head"))
    rows = rows.where("doc_id is not null and page is not null and (first_question is not null or begun is not null or english)")
    heads = _listed(by=("first_question", "last_question", "idx", "head"), where=F.col("first_question").isNotNull())
    starts = _listed(by=("idx", "y", "begun"), where=F.col("begun").isNotNull())
    pages = rows.groupBy(*PAGE).agg(F.array_sort(heads).alias("heads"), F.array_sort(starts).alias("starts"), _listed(where=F.col("english")).alias("english")).where(F.size("heads") > 0)
    behind = lambda z, i: F.get("heads", i + 1)
    last = lambda z, i: (i == F.size("heads") - 1) | (behind(z, i)["first_question"] != z["first_question"]) | (behind(z, i)["last_question"] != z["last_question"])
    pages = layout.settled(pages, heads=F.filter("heads", last))
    end = lambda z: F.get(F.filter("starts", lambda s: (s["begun"] == z["first_question"]) & (s["idx"] > z["idx"])), F.lit(0))
    pages = layout.settled(pages, heads=F.transform("heads", lambda z: z.withField("end", end(z))))
    inside = lambda z: F.filter("english", lambda s: (s["idx"] > z["idx"]) & (z["end"]["idx"].isNull() | (s["idx"] < z["end"]["idx"])) & (s["y"] >= z["head"] - 0.01))
    pages = layout.settled(pages, heads=F.transform("heads", lambda z: z.withField("bounds", _bounds_of(inside(z)))))
    rows = pages.select(*PAGE, F.explode("heads").alias("z")).select(*PAGE, "z.first_question", "z.last_question", "z.head", F.col("z.end.y").alias("stop"), _box_of(F.col("z.bounds"), "b"))
    b = F.col("b")
    text_box = clamped_box(F.greatest(F.lit(0.06), b["x"] - 0.01), F.greatest(F.lit(0.0), b["y"] - 0.005), F.least(F.lit(0.92), b["w"] + 0.02), F.least(0.95 - b["y"], b["h"] + 0.015))
    between = F.when(F.col("stop") > F.col("head"), clamped_box(F.lit(0.08), F.col("head") + 0.005, F.lit(0.84), F.col("stop") - F.col("head") - 0.01))
    return rows.select(*PAGE, "first_question", "last_question", F.when(b.isNotNull(), text_box).otherwise(between).alias("box")).where("box is not null")


def question_places(spans: DataFrame) -> DataFrame:
    """(doc_id, page, number, x, y): the bare number of a question, rather one that text follows on its row, else its anchor.

    A page's candidates are arrays on its row.
    """
    bare = r"^(\d{1,3})\.?$"
    trimmed = T.trim(F.col("text"))
    rows = spans.select(*PAGE, "x", "y", F.when(trimmed.rlike(bare), F.regexp_extract(trimmed, bare, 1).cast("int")).alias("bare"), layout.question_number(F.col("text")).alias("label"), F.col("text").rlike(r"(?i)^\s*\.|graphic|\([A-D]\)").alias("said"))
    rows = rows.where("bare is not null or label is not null or said")
    pages = rows.groupBy(*PAGE).agg(_listed(by=("bare", "x", "y"), where=F.col("bare").isNotNull()).alias("bare"), _listed(by=("label", "x", "y"), where=F.col("label").isNotNull()).alias("label"), _listed(by=("x", "y"), where=F.col("said")).alias("said"))
    place = lambda number, kind, z: F.struct(number.alias("number"), kind.alias("kind"), z["y"].alias("y"), z["x"].alias("x"))
    followed = lambda z: F.exists("said", lambda o: F.coalesce((o["x"] > z["x"]) & (F.abs(o["y"] - z["y"]) <= SAME_ROW), F.lit(False)))
    found = F.concat(F.transform("bare", lambda z: place(z["bare"], F.when(followed(z), 0).otherwise(1), z)), F.transform("label", lambda z: place(z["label"], F.lit(2), z)))
    pages = layout.settled(pages.where(F.size("bare") + F.size("label") > 0), found=F.array_sort(found))
    first = F.filter("found", lambda z, i: (i == 0) | (F.get("found", i - 1)["number"] != z["number"]))
    return pages.select(*PAGE, F.explode(first).alias("z")).select(*PAGE, "z.number", "z.x", "z.y")


def _in_band(box: Column, left: Column, right: Column, top: Column, bottom: Column) -> Column:
    """A box cut to a column band and a window of heights."""
    x, y = F.greatest(left, box["x"]), F.greatest(top, box["y"])
    return clamped_box(x, y, F.least(right, box["x"] + box["w"]) - x, F.least(bottom, box["y"] + box["h"]) - y)


def _grown(box: Column, edge: tuple[float, float, float, float, float]) -> Column:
    """A box grown on all sides, from a least x and y on, with a most width and height."""
    x, y, w, h, by = edge
    return clamped_box(F.greatest(F.lit(x), box["x"] - by), F.greatest(F.lit(y), box["y"] - by), F.least(F.lit(w), box["w"] + 2 * by), F.least(F.lit(h), box["h"] + 2 * by))


def graphic_boxes(spans: DataFrame, images: DataFrame, groups: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, first_question, box): the graphic above a group's first question.

    It lies between the content above in the column (its lowest line with options
    or a question, else a distance below the last question of the group before)
    and the question. The largest image there wins, then text with graphic cues,
    then the whole strip. ``images`` has doc_id, page, x, y, w, h; ``groups``
    doc_id, first_question, last_question; ``lines`` the pages' lines, if they are known.
    """
    cue = F.col("text").rlike(CUES) | ((F.col("x") > 0.45) & F.col("text").rlike(r"\$[\d,]+")) | ((F.col("x") > 0.5) & F.col("text").rlike(r"(?i)\$|Cost|Company"))
    places = question_places(spans).withColumnRenamed("number", "first_question")
    asked = groups.join(places, ["doc_id", "first_question"]).select(*PAGE, F.struct("first_question", "last_question", F.col("x").alias("qx"), F.col("y").alias("qy")).alias("group"))
    found = spans.select(*PAGE, F.struct("x", "y", layout.question_number(F.col("text")).alias("number")).alias("label"), F.when(cue, F.struct("x", "y", "w", "h")).alias("cue"))
    found = found.withColumn("label", F.when(F.col("label.number").isNotNull(), F.col("label"))).where("label is not null or cue is not null")
    content = (layout.lines(spans) if lines is None else lines).where(F.col("line").rlike(r"\([A-D]\)|^\d{1,3}\s*\.")).select(*PAGE, F.struct("column", "bottom").alias("content"))
    rows = asked
    for part in (found, content, images.select(*PAGE, F.struct("x", "y", "w", "h").alias("image"))):
        rows = rows.unionByName(part, allowMissingColumns=True)
    # All that a page has meets on its row.
    pages = rows.groupBy(*PAGE).agg(*(F.collect_list(n).alias(f"{n}s") for n in ("group", "label", "cue", "content", "image"))).where(F.size("groups") > 0)
    pages = layout.settled(pages, _left=F.exists("labels", lambda z: F.coalesce(z["x"] < 0.5, F.lit(False))), _right=F.array_min(F.filter(F.transform("labels", lambda z: z["x"]), lambda x: x >= 0.5)))
    dual = F.col("_left") & F.col("_right").isNotNull()
    pages = layout.settled(pages, dual=dual, split_x=F.when(dual, F.greatest(F.lit(0.45), F.col("_right") - 0.02)).otherwise(0.5))
    side = lambda g: F.when(g["qx"] < F.col("split_x"), "left").otherwise("right")
    column = lambda z: F.when(~F.col("dual"), "single").when(z["x"] < F.col("split_x"), "left").otherwise("right")
    pages = layout.settled(pages, labels=F.transform("labels", lambda z: z.withField("column", column(z))), groups=F.transform("groups", lambda g: g.withField("side", side(g)).withField("bottom", g["qy"] - ABOVE_QUESTION)))
    beside = lambda z, g: (z["column"] == "single") | (z["column"] == g["side"])
    lowest = lambda g: F.array_max(F.transform(F.filter("contents", lambda z: beside(z, g) & (z["bottom"] <= g["bottom"])), lambda z: z["bottom"]))
    highest = lambda number, fits: F.array_min(F.transform(F.filter("labels", lambda z: (z["number"] == number) & fits(z)), lambda z: z["y"]))
    before = lambda g: highest(g["first_question"] - 1, lambda z: beside(z, g))
    end_y = lambda g: F.coalesce(highest(g["last_question"] + 1, lambda z: F.lit(True)), highest(g["last_question"], lambda z: F.lit(True)))
    ceiling = lambda g: F.coalesce(lowest(g) + BELOW_CONTENT, before(g) + BELOW_GROUP, F.lit(0.0))
    top = lambda g: F.greatest(F.lit(PAGE_TOP), g["bottom"] - MOST_HEIGHT, ceiling(g))
    pages = layout.settled(pages, groups=F.transform("groups", lambda g: g.withField("top", top(g)).withField("end_y", end_y(g))))
    area = lambda z: z["w"] * z["h"]
    middle = lambda z: z["x"] + z["w"] / 2
    fits = lambda z, g: (z["y"] + z["h"] <= g["bottom"] + 0.01) & (z["y"] >= g["top"] - 0.01) & (area(z) >= LEAST_IMAGE) & F.when(g["side"] == "left", middle(z) < DIVIDER).otherwise(middle(z) >= DIVIDER)
    best = lambda g: F.array_max(F.transform(F.filter("images", lambda z: fits(z, g)), lambda z: F.struct(area(z).alias("area"), *(z[n].alias(n) for n in "xywh"))))
    near = lambda g: F.filter("cues", lambda z: (z["y"] + z["h"] >= g["qy"] - CUE_ABOVE) & (z["y"] <= F.coalesce(g["end_y"] + CUE_BEHIND, g["qy"] + CUE_BELOW)))
    tall = F.filter("groups", lambda g: g["bottom"] - g["top"] >= 0.02)
    pages = layout.settled(pages, groups=F.transform(tall, lambda g: g.withField("image", best(g)).withField("bounds", _bounds_of(near(g)))))
    rows = pages.select(*PAGE, F.explode("groups").alias("g")).select(*PAGE, "g.first_question", "g.side", "g.top", "g.bottom", "g.image", _box_of(F.col("g.bounds"), "cue"))
    left = F.col("side") == "left"
    rows = rows.withColumn("band_l", F.when(left, LEFT_BAND[0]).otherwise(RIGHT_BAND[0])).withColumn("band_r", F.when(left, LEFT_BAND[1]).otherwise(RIGHT_BAND[1])).withColumn("cued", F.when(F.col("cue").isNotNull(), _grown(F.col("cue"), CUE_EDGE)))
    cut = lambda box: _in_band(box, F.col("band_l"), F.col("band_r"), F.col("top"), F.col("bottom"))
    strip = clamped_box(F.col("band_l"), F.col("top"), F.col("band_r") - F.col("band_l"), F.col("bottom") - F.col("top"))
    grown = _grown(F.col("image"), IMAGE_EDGE)
    pictured = F.get(F.transform(F.array(grown), lambda b: F.coalesce(cut(b), b)), F.lit(0))  # the lambda's argument is computed once
    box = F.coalesce(F.when(F.col("image").isNotNull(), pictured), F.when(F.col("cued").isNotNull(), cut(F.col("cued"))), strip)
    return rows.select(*PAGE, "first_question", box.alias("box")).where("box is not null")


def resolved(given: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, first_question, box): a group's own box, else the one found on its page, else null."""
    other = found.select("doc_id", "first_question", F.col("box").alias("found_box"))
    return given.join(other, ["doc_id", "first_question"], "left").select("doc_id", "first_question", F.coalesce("box", "found_box").alias("box"))

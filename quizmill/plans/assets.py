"""Images of question groups in two phases: pages are rendered once each, then cut.

``groups`` are rows (doc_id, part_number, group_no, page, pages, box, questions, passage):
page and pages say where a group stands (pages: array<int>), box is a struct x, y, w, h or
null, questions an array of numbers. ``documents`` has doc_id, content and pages (how many).
Renderer, text scan, box detection and clipping are injected functions; what they raise is
kept as a row's error and leaves the other rows as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.functions.numbers import clamped_box, overlap_share, remapped
from quizmill.model import LEAST_OVERLAP, READING_PARTS

#: Parts whose groups have images, and those whose images have clickable words.
WITH_IMAGES, WITH_WORDS = (1, 3, 4, 6, 7), (6, 7)
#: Pages of a document that one call of a task renders; bounds what travels with its content.
PAGES_AT_ONCE = 64
#: Rows and bytes of images that a task hands back in one frame; bound its memory.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 16 << 20
PAGE = ["doc_id", "page"]
GROUP = ["doc_id", "part_number", "group_no"]
REGION = "struct<id:string,text:string,x:double,y:double,w:double,h:double>"


def is_full(box: Column) -> Column:
    """Whether a box is the whole page."""
    return (box["x"] <= 0.01) & (box["y"] <= 0.01) & (box["w"] >= 0.99) & (box["h"] >= 0.99)


def asset_key(exam: Column, test: Column) -> Column:
    """The object key of a row of ``cut``: a photo by its question, a whole page by its number, else by its group."""
    place = F.when(F.col("part_number") == 1, F.concat(F.lit("q-"), F.col("question_number").cast("string"))).when(F.col("whole"), F.concat(F.lit("page-"), F.col("page").cast("string"))).otherwise(F.concat(F.lit("group-"), F.col("group_no").cast("string")))
    return F.concat(F.lit("passages/"), exam, F.lit("/"), test, F.lit("/part-"), F.col("part_number").cast("string"), F.lit("/"), place, F.lit(".png"))


def placed(groups: DataFrame) -> DataFrame:
    """Groups that have images, with the page of their image and all of their pages; a box is cut to its page."""
    pages = F.array_distinct(F.filter(F.coalesce("pages", F.array().cast("array<int>")), lambda p: p.isNotNull()))
    box = clamped_box(F.col("box.x"), F.col("box.y"), F.col("box.w"), F.col("box.h"))
    rows = groups.where(F.col("part_number").isin(*WITH_IMAGES)).withColumn("pages", pages).withColumn("page", F.coalesce("page", F.get("pages", F.lit(0))))
    rows = rows.withColumn("box", F.when(F.col("box").isNotNull(), box))
    return rows.withColumn("pages", F.when(F.size("pages") > 0, F.col("pages")).otherwise(F.array_compact(F.array("page"))))


def _whole_pages(rows: DataFrame) -> Column:
    """Whether a group shows its whole pages, or may (its box is not known yet)."""
    return F.col("part_number").isin(*WITH_WORDS) & (F.col("box").isNull() | is_full(F.col("box")))


def page_requests(groups: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, page, scan): every page that images are cut from, once, and whether its words are wanted; pages that a document lacks are left out."""
    rows = placed(groups).where("page is not null")
    pages = F.when(_whole_pages(rows), F.array_distinct(F.concat(F.array("page"), "pages"))).otherwise(F.array("page"))
    asked = rows.select("doc_id", F.explode(pages).alias("page"), F.col("part_number").isin(*WITH_WORDS).alias("scan")).groupBy(*PAGE).agg(F.bool_or("scan").alias("scan"))
    return asked.join(documents.select("doc_id", F.col("pages").alias("_last")), "doc_id").where(F.col("page").between(1, F.col("_last"))).drop("_last")


def rendered(requests: DataFrame, documents: DataFrame, render: Callable[[bytes, int], bytes], scan: Callable[[bytes], list[dict]]) -> DataFrame:
    """(doc_id, page, image, regions, error): one call of ``render`` for each request, and of ``scan`` for those that want words.

    A document's content travels once for PAGES_AT_ONCE of its pages. A page whose
    scan fails has no regions.
    """
    chunk = F.floor((F.col("page") - 1) / PAGES_AT_ONCE)
    asked = requests.groupBy("doc_id", chunk.alias("_chunk")).agg(F.array_sort(F.collect_list(F.struct("page", "scan"))).alias("asked"))
    rows = asked.join(documents.select("doc_id", "content"), "doc_id").select("doc_id", "content", "asked")
    kind = requests.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in frames:
            for doc_id, content, pages in zip(pdf["doc_id"], pdf["content"], pdf["asked"], strict=True):
                for asked in pages:
                    image, regions, error = None, None, None
                    try:
                        image = render(content, int(asked["page"]))
                        regions = _scanned(scan, image) if asked["scan"] else None
                    except Exception as failure:  # noqa: BLE001
                        error = f"render: {failure}"
                    yield doc_id, int(asked["page"]), image, regions, error

    names = ["doc_id", "page", "image", "regions", "error"]

    return rows.mapInPandas(lambda frames: _framed(run(frames), names), f"doc_id {kind}, page int, image binary, regions array<{REGION}>, error string")


def _framed(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of ROWS_AT_ONCE, or of fewer once they hold BYTES_AT_ONCE of images: a frame has a price of its own."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
            yield pd.DataFrame({n: [r[k] for r in held] for k, n in enumerate(names)}, dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame({n: [r[k] for r in held] for k, n in enumerate(names)}, dtype=object)


def _scanned(scan: Callable[[bytes], list[dict]], image: bytes) -> list[dict] | None:
    try:
        return scan(image)
    except Exception:  # noqa: BLE001  (words are an extra: the image stays)
        return None


def _by_page(wants: DataFrame, pages: DataFrame, kind: str, run: Callable[[tuple], Iterator[tuple]], names: list[str], schema: str) -> DataFrame:
    """Runs over every page with what is wanted of it (an array of structs), so that its image travels once."""
    wanted = wants.groupBy(*PAGE).agg(F.array_sort(F.collect_list("want")).alias("wants"))
    rows = wanted.join(pages, PAGE, "left").select(*PAGE, "image", "error", "wants")

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (out for pdf in frames for row in pdf.itertuples(index=False, name=None) for out in run(row))
        return _framed(found, names)

    return rows.mapInPandas(each, schema)


def boxed(groups: DataFrame, pages: DataFrame, detect: Callable[[bytes, dict], list[float] | None]) -> DataFrame:
    """``placed`` groups with a box: their own, else what ``detect`` finds on their page (it gets part_number, questions and passage); box_error if it fails."""
    rows = placed(groups)
    want = F.struct("part_number", "group_no", "questions", "passage").alias("want")
    asked = rows.where("box is null and page is not null and size(questions) > 0").select(*PAGE, want)
    kinds = {c: groups.schema[c].dataType.simpleString() for c in ("doc_id", "group_no")}

    def run(row: tuple) -> Iterator[tuple]:
        doc_id, _, image, error, wants = row
        for want in wants:
            found, failed = None, error
            if image is not None:
                try:
                    found = detect(image, {k: want[k] for k in ("part_number", "questions", "passage")})
                except Exception as failure:  # noqa: BLE001
                    failed = f"detect: {failure}"
            yield doc_id, int(want["part_number"]), want["group_no"], None if found is None else [float(v) for v in found], failed

    names = [*GROUP, "_found", "box_error"]
    found = _by_page(asked, pages, kinds["doc_id"], run, names, f"doc_id {kinds['doc_id']}, part_number int, group_no {kinds['group_no']}, _found array<double>, box_error string")
    own = F.when(F.size("_found") == 4, clamped_box(*(F.get("_found", F.lit(k)) for k in range(4))))
    return rows.join(found, GROUP, "left").withColumn("box", F.coalesce("box", own)).drop("_found")


def cut(groups: DataFrame, pages: DataFrame, clip: Callable[[bytes, dict], bytes], scan: Callable[[bytes], list[dict]]) -> DataFrame:
    """(doc_id, part_number, group_no, question_number, place, page, whole, image, regions, error): every image of every group.

    A reading group whose box is the whole page has an image for each of its pages, with
    the page's words. Other groups have one, cut out by their box; in reading parts with
    the words that lie in it, in its coordinates, or those of a scan of the cut image if
    none do. A photo's image belongs to its question. ``groups`` come from ``boxed`` or ``placed``.
    """
    rows = (groups if "box_error" in groups.columns else groups.withColumn("box_error", F.lit(None).cast("string"))).where("page is not null")
    whole = F.coalesce(F.col("part_number").isin(*WITH_WORDS) & is_full(F.col("box")), F.lit(False))
    rows = rows.withColumn("whole", whole).select(*GROUP, "whole", "box", "box_error", F.get("questions", F.lit(0)).alias("question"), F.posexplode(F.when(F.col("whole"), F.col("pages")).otherwise(F.array("page"))).alias("place", "page"))
    # Words are moved into each crop by columns, before any image is read.
    words = pages.select(*PAGE, F.col("regions").alias("_words"))
    region = lambda r: F.struct(r["id"].alias("id"), r["text"].alias("text"), *(remapped(r, F.col("box"))[n].alias(n) for n in "xywh"))
    inside = F.filter(F.transform(F.filter("_words", lambda r: overlap_share(r, F.col("box")) >= LEAST_OVERLAP), region), lambda r: r["x"].isNotNull())
    rows = rows.join(words, PAGE, "left").withColumn("regions", F.when(F.col("part_number").isin(*WITH_WORDS), F.when(F.col("whole"), F.col("_words")).otherwise(inside)))
    want = F.struct("part_number", "group_no", "place", "whole", "box", "box_error", "question", "regions").alias("want")
    kinds = {c: groups.schema[c].dataType.simpleString() for c in ("doc_id", "group_no")}

    def run(row: tuple) -> Iterator[tuple]:
        doc_id, page, image, error, wants = row
        for want in wants:
            out, words, failed = None, want["regions"], error or want["box_error"]
            words = None if words is None else list(words)
            if image is None:
                failed = failed or "no such page"
            elif want["whole"]:
                out = image
            elif want["box"] is None:
                failed = failed or "no box"
            else:
                try:
                    out = clip(image, dict(want["box"]))
                    if want["part_number"] in WITH_WORDS and not words:
                        words = _scanned(scan, out)
                except Exception as failure:  # noqa: BLE001
                    failed = f"clip: {failure}"
            question = want["question"] if want["part_number"] == 1 else None
            yield doc_id, int(want["part_number"]), want["group_no"], question, int(want["place"]), int(page), bool(want["whole"]), out, words if out is not None and words is not None and len(words) else None, failed if out is None else None

    names = [*GROUP, "question_number", "place", "page", "whole", "image", "regions", "error"]
    schema = f"doc_id {kinds['doc_id']}, part_number int, group_no {kinds['group_no']}, question_number int, place int, page int, whole boolean, image binary, regions array<{REGION}>, error string"
    return _by_page(rows.select(*PAGE, want), pages, kinds["doc_id"], run, names, schema)


def prepared(groups: DataFrame, documents: DataFrame, folder: str, render, clip, scan, detect=None) -> DataFrame:
    """The images of ``cut`` for every group; rendered pages are written below ``folder``, so that each is rendered once, whoever reads it."""
    spark = groups.sparkSession
    rendered(page_requests(groups, documents), documents, render, scan).write.mode("overwrite").parquet(f"{folder}/pages")
    pages = spark.read.parquet(f"{folder}/pages")
    return cut(boxed(groups, pages, detect) if detect else placed(groups), pages, clip, scan)


def group_assets(images: DataFrame) -> DataFrame:
    """(doc_id, part_number, group_no, image, regions, images, question_images): what a group shows.

    ``images`` are rows of ``cut`` with a ``key`` in place of the image's bytes. The first
    image and the first words of a group are its own; photos are kept by question.
    """
    good = images.where("error is null")
    at = F.struct("place", "page", "key", "regions")
    shown = F.array_sort(F.collect_list(F.when(F.col("part_number") > 1, at)))
    reading = F.col("part_number").isin(*READING_PARTS)
    photos = F.map_from_entries(F.array_sort(F.collect_list(F.when((F.col("part_number") == 1) & F.col("question_number").isNotNull(), F.struct("question_number", "key")))))
    rows = good.groupBy(*GROUP).agg(shown.alias("s"), photos.alias("question_images"))
    listed = F.transform("s", lambda i: F.struct(i["page"].alias("page"), i["key"].alias("key"), i["regions"].alias("regions")))
    words = F.get(F.filter(F.transform("s", lambda i: i["regions"]), lambda r: r.isNotNull()), F.lit(0))
    return rows.select(*GROUP, F.get("s", F.lit(0))["key"].alias("image"), words.alias("regions"), F.when(reading, listed).alias("images"), "question_images")

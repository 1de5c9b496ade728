"""Images of question groups with stand-ins for renderer, scan, detection and clipping (P-1 to P-3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.plans import assets
from quizmill.plans.scratch import written
from quizmill.registry import query


def render(content: bytes, page: int) -> bytes:
    if page % 5 == 0:
        raise ValueError("page")
    return content + f":{page}".encode()


def scan(image: bytes) -> list[dict]:
    return [{"id": f"w{k}", "text": image.decode(), "x": at, "y": at, "w": 0.1, "h": 0.1} for k, at in ((1, 0.2), (2, 0.8))]


def clip(image: bytes, box: dict) -> bytes:
    return image + f"@{box['x']:.2f}".encode()


def detect(image: bytes, asked: dict) -> list[float] | None:
    if asked["part_number"] == 6:
        raise ValueError("unclear")
    return {1: [0.6, 0.6, 0.3, 0.3], 3: [0.2, 0.2, 0.4, 0.4], 7: [0.0, 0.0, 1.0, 1.0]}.get(asked["part_number"])


def question_groups(t):
    """Every question as a group of its own, on pages 1 to 13 of documents with 12; a third has no box yet."""
    q, page, kind = t.questions(), F.col("size") % 12 + 1, F.col("size") % 3
    side = F.when(F.col("size") % 2 == 0, 0.1).otherwise(0.35)
    box = lambda x, w: F.struct(x.alias("x"), x.alias("y"), w.alias("w"), w.alias("h"))
    groups = q.select(
        F.floor(F.col("question_id") / 40).alias("doc_id"), "part_number", F.col("question_id").alias("group_no"), page.cast("int").alias("page"), F.array(page, page + 1).cast("array<int>").alias("pages"),
        F.when(kind == 0, box(F.lit(0.0), F.lit(1.0))).when(kind == 1, box(side, F.lit(0.3))).alias("box"), F.array("question_number").alias("questions"), "passage",
    )
    documents = groups.select("doc_id").distinct().select("doc_id", F.col("doc_id").cast("string").cast("binary").alias("content"), F.lit(12).alias("pages"))
    return groups, documents


_GROUPS = """,
gr AS (SELECT (question_id // 40)::BIGINT AS doc_id, part_number, question_id AS group_no, (size % 12 + 1)::INTEGER AS page, size % 3 AS kind, size, question_number FROM questions WHERE part_number IN (1, 3, 4, 6, 7)),
bx AS (SELECT *, CASE WHEN kind = 0 THEN 0.0 WHEN kind = 1 THEN CASE WHEN size % 2 = 0 THEN 0.1 ELSE 0.35 END WHEN page % 5 = 0 THEN NULL WHEN part_number = 1 THEN 0.6 WHEN part_number = 3 THEN 0.2 WHEN part_number = 7 THEN 0.0 END AS x FROM gr),
pl AS (SELECT *, part_number >= 6 AND x IS NOT NULL AND x = 0.0 AS whole FROM bx),
im AS (SELECT *, place::INTEGER AS nth, page + place AS p FROM (SELECT *, unnest(CASE WHEN whole THEN [0, 1] ELSE [0] END) AS place FROM pl))
"""
_ERROR = """CASE WHEN p % 5 = 0 THEN 'render: page' WHEN p > 12 THEN 'no such page' WHEN whole OR x IS NOT NULL THEN NULL WHEN part_number = 6 THEN 'detect: unclear' ELSE 'no box' END"""


@query("p1_page_requests", _GROUPS + """,
rq AS (SELECT doc_id, unnest(CASE WHEN part_number >= 6 AND kind <> 1 THEN [page, page + 1] ELSE [page] END) AS page, part_number >= 6 AS scan FROM gr)
SELECT doc_id, page::INTEGER AS page, bool_or(scan) AS scan FROM rq WHERE page <= 12 GROUP BY 1, 2
""")
def page_requests(t):
    return assets.page_requests(*question_groups(t))


def images(t):
    groups, documents = question_groups(t)
    pages = written(assets.rendered(assets.page_requests(groups, documents), documents, render, scan), "asset-pages")
    return assets.cut(assets.boxed(groups, pages, detect), pages, clip, scan)


@query("p2_group_images", _GROUPS + f"""
SELECT doc_id, part_number, group_no, CASE WHEN part_number = 1 THEN question_number END AS question_number, nth AS place, p::INTEGER AS page, CASE WHEN {_ERROR} IS NULL THEN doc_id || ':' || p || CASE WHEN whole THEN '' ELSE '@' || printf('%.2f', x) END END AS image,
  CASE WHEN {_ERROR} IS NULL AND part_number >= 6 THEN CASE WHEN whole OR x > 0.3 THEN 2 ELSE 1 END END::BIGINT AS words, {_ERROR} AS error FROM im
""")
def group_images(t):
    words = F.when(F.col("regions").isNotNull(), F.size("regions")).cast("long")
    return images(t).select("doc_id", "part_number", "group_no", "question_number", "place", "page", F.col("image").cast("string").alias("image"), words.alias("words"), "error")


@query("p3_group_assets", _GROUPS + f"""
SELECT doc_id, part_number, group_no, string_agg('passages/toeic/' || doc_id || '/part-' || part_number || '/' || CASE WHEN part_number = 1 THEN 'q-' || question_number WHEN whole THEN 'page-' || p ELSE 'group-' || group_no END || '.png', ',' ORDER BY nth) AS keys, count(*) AS n
FROM im WHERE {_ERROR} IS NULL GROUP BY 1, 2, 3
""")
def group_assets(t):
    found = images(t).withColumn("key", assets.asset_key(F.lit("toeic"), F.col("doc_id").cast("string"))).drop("image")
    rows = assets.group_assets(found)
    keys = F.when(F.col("part_number") == 1, F.map_values("question_images")).when(F.col("images").isNotNull(), F.transform("images", lambda i: i["key"])).otherwise(F.array("image"))
    return rows.select("doc_id", "part_number", "group_no", F.array_join(keys, ",").alias("keys"), F.size(keys).cast("long").alias("n"))

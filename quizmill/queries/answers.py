"""Typed and continued model answers with stand-ins for the model, and the moves of jobs (E-5 to E-7, E-9, C-2, M-14)."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quizmill.operators import coercion
from quizmill.operators.coercion import box_of
from quizmill.plans import rounds, tasks
from quizmill.plans.scratch import written
from quizmill.queries.pages import _BOX
from quizmill.registry import query
from quizmill.streaming import jobs


def model(prompts: list[str]) -> list[str | None]:
    """Answers each task from its input alone."""
    out: list[str | None] = []
    for p in map(json.loads, prompts):
        given = p["input"]
        if p["task"] == "answer_key":
            pairs = [x.split(":") for x in given["text"].split()]
            out.append(json.dumps({"answers": [{"number": int(n), "letter": letter} for n, letter in pairs]}))
        elif p["task"] == "file_role":
            out.append({"click": '{"role": "EXAM_DOC", "confidence": 0.95}', "view": '{"role": "AUDIO_FILE", "confidence": 1.5}', "error": "I cannot say", "purchase": None}.get(given["name"], '{"kind": "other"}'))
        else:
            out.append(json.dumps({"bbox": json.loads(given["page"])}))
    return out


@query("e5_answer_keys", "SELECT test_id || '-' || group_name AS key, question_number AS number, CASE WHEN correct = 'A' THEN 'A' END AS letter, CASE WHEN correct <> 'A' THEN 'letter' END AS error FROM questions")
def answer_keys(t):
    """Keys of a test's groups; letters beyond D are errors."""
    key = F.concat_ws("-", F.col("test_id").cast("string"), "group_name")
    texts = t.questions().groupBy(key.alias("key")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("question_number").cast("string"), "correct"))), " ").alias("text"))
    found = tasks.ANSWER_KEY.answers(tasks.asked([tasks.ANSWER_KEY.requests(texts, "key")], model))
    return found.select("key", "item.number", F.when(F.col("error").isNull(), F.col("item.letter")).alias("letter"), "error")


_ROLE = "CASE word WHEN 'click' THEN {} WHEN 'view' THEN {} WHEN 'error' THEN {} WHEN 'purchase' THEN {} ELSE {} END"


@query("e7_roles_and_boxes", _BOX + f"""
SELECT 'role-' || word_id AS key, CASE WHEN word = 'click' THEN 'EXAM_DOC' END AS role, NULL::DOUBLE AS width, {_ROLE.format("NULL", "'confidence'", "'not JSON'", "'no answer'", "'shape'")} AS error FROM words
UNION ALL SELECT 'box-' || b.vec_id, NULL, CASE WHEN c.w >= 0.02 AND c.h >= 0.02 THEN c.w END, CASE WHEN c.w >= 0.02 AND c.h >= 0.02 THEN NULL ELSE 'box' END FROM boxes b JOIN cl c ON c.vec_id = b.vec_id
""")
def roles_and_boxes(t):
    """Two tasks in one batched call."""
    files = t.words().select("word_id", F.col("word").alias("name"), F.lit("").alias("sample"))
    pages = t.boxes().select("vec_id", F.to_json(F.array("x", "y", "w", "h")).alias("page"), F.array(F.lit(1)).alias("questions"))
    asked = written(tasks.asked([tasks.FILE_ROLE.requests(files, "word_id"), tasks.GROUP_BOX.requests(pages, "vec_id")], model, tries=1), "answers")
    role, box = tasks.FILE_ROLE.answers(asked), tasks.GROUP_BOX.answers(asked)
    good = F.col("error").isNull()
    rows = role.select(F.concat(F.lit("role-"), "key").alias("key"), F.when(good, F.col("item.role")).alias("role"), F.lit(None).cast("double").alias("width"), "error")
    return rows.unionByName(box.select(F.concat(F.lit("box-"), "key").alias("key"), F.lit(None).cast("string").alias("role"), F.when(good, box_of(F.col("item.bbox"))["w"]).alias("width"), "error"))


#: Characters that the stand-in gives at once.
PIECE = 300


def cut_off(prompts: list[str]) -> list[str | None]:
    """The raw part with its texts in capitals, PIECE characters at a time."""
    out: list[str | None] = []
    for prompt in prompts:
        asked = json.loads(prompt)
        raw = asked["raw"]
        for q in raw["questions"]:
            q["text"] = q["text"].upper()
        out.append(json.dumps(raw)[asked.get("had", 0) :][:PIECE])
    return out


@query("e9_normalised_questions")
def normalised_questions(t):
    """Groups of questions through three rounds of a model that stops; what it does not reach comes from the raw data."""
    item = F.struct(F.col("question_id").alias("number"), F.col("question_text").alias("text"))
    raw = t.questions().groupBy("test_id", "group_name").agg(F.array_sort(F.collect_list(item)).alias("questions"))
    raw = raw.select(F.concat_ws("-", F.col("test_id").cast("string"), "group_name").alias("key"), "questions")
    asked = raw.select("key", F.to_json(F.struct(F.struct("questions").alias("raw"))).alias("prompt"))
    said = rounds.continued(asked, "key", "prompt", cut_off, lambda prompt, text: json.dumps(json.loads(prompt) | {"had": len(text)}), 3)
    text = F.when(F.col("whole"), F.col("text")).otherwise(rounds.salvaged(F.col("text")))
    found = said.select("key", "rounds", F.explode(coercion.questions_of(F.try_variant_get(F.try_parse_json(text), "$.questions", "variant"))).alias("q"))
    found = found.select("key", F.get_json_object("q", "$.number").cast("long").alias("number"), F.get_json_object("q", "$.text").alias("text"))
    given = raw.select("key", F.explode("questions").alias("q")).select("key", F.col("q.number").cast("long").alias("number"), "q.text")
    return rounds.backfilled(found, given, ["key", "number"])


@query("c2_job_moves")
def job_moves(t):
    """Users' events as wanted states of jobs."""
    states = F.array(*[F.lit(s) for s in ("QUEUED", "EXTRACTING", "CLASSIFYING", "IMPORTING", "DONE", "FAILED")])
    events = t.words().select(F.col("user_id").alias("job_id"), F.col("created_at").cast("timestamp").alias("at"), F.get(states, F.pmod(F.col("word_id"), F.lit(6)).cast("int")).alias("wanted"))
    return jobs.moves(events, 24 * 60 * 60 * 1_000)

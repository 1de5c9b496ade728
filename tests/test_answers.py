"""Continued and typed model answers, and the moves of jobs as a stream."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quizmill.plans import rounds, tasks
from quizmill.streaming import jobs

DOCUMENT = {"partNumber": 7, "note": 'a "quoted" \\ {text}', "ok": True, "groups": [{"passage": "p, [q]", "questions": [{"n": 1, "t": "é"}, {"n": 2, "t": "]}"}]}, {"questions": []}, {"passage": "r", "questions": [{"n": -3.5e2, "t": None}]}], "last": 12}


def leaves(doc):
    return [q for g in doc.get("groups", []) for q in g.get("questions", [])]


@pytest.mark.parametrize("indent", [None, 2])
def test_every_cut_keeps_the_whole_elements(indent):
    text = json.dumps(DOCUMENT, indent=indent, ensure_ascii=False)
    ends = [k + 1 for k, c in enumerate(text) if c == "}"]
    questions = [text.index("}", text.index(mark)) + 1 for mark in ('"n": 1', '"n": 2', '"n": -350')]
    questions[1] = text.index("}", text.index("]}") + 2) + 1  # its text has a bracket
    assert questions == sorted(questions) and set(questions) <= set(ends)
    for cut in range(len(text) + 1):
        kept = rounds.whole_elements(text[:cut])
        if kept is None:
            assert cut == 0
            continue
        doc = json.loads(kept)
        assert {k: v for k, v in doc.items() if k != "groups"}.items() <= DOCUMENT.items()
        assert leaves(doc) == leaves(DOCUMENT)[: sum(end <= cut for end in questions)], text[:cut]
    assert json.loads(rounds.whole_elements(text)) == DOCUMENT


def test_arrays_numbers_and_nonsense():
    assert [rounds.whole_elements(t) for t in ("[1, 2, 3", "[1, 2,", "[[1, 2], [3", '["a", "b', "[tru", '{"a": 1, "b": 2', '{"a": ', "12", "no", "", "]", "[1}")] == ["[1, 2]", "[1, 2]", "[[1, 2]]", '["a"]', "[]", '{"a": 1}', "{}", "12", None, None, None, "[1]"]


def test_rounds_ask_for_open_rows_only(spark, tmp_path):
    whole = {k: json.dumps({"questions": [{"n": i, "t": "x" * k} for i in range(k)]}) for k in range(1, 6)}

    def model(prompts):
        out = []
        for p in prompts:
            k, had = (int(x) for x in p.split())
            with open(tmp_path / str(k), "a") as f:
                f.write("x")
            if k == 5:
                raise OSError("down")
            out.append(whole[k][had : had + 40])
        return out

    rows = spark.createDataFrame([(k, f"{k} 0") for k in whole], "k int, prompt string").repartition(5, "k")
    got = {r.k: r for r in rounds.continued(rows.select("k", "prompt"), "k", "prompt", model, lambda p, t: f"{p.split()[0]} {len(t)}", 3).collect()}
    need = {k: -(-len(whole[k]) // 40) for k in range(1, 5)}
    alone = {p.name: len(p.read_text()) for p in tmp_path.iterdir()}
    assert set(got) == set(whole) and not got[5].whole and got[5].text == ""
    for k in range(1, 5):
        if got[k].text:  # a batch with row 5 fails as a whole
            assert got[k].whole == (need[k] <= 3) and got[k].rounds == min(3, need[k]) == alone[str(k)] and whole[k].startswith(got[k].text)
    found = spark.createDataFrame([(1, 2, "said")], "k int, n int, t string")
    raw = spark.createDataFrame([(1, 2, "raw"), (1, 3, "raw")], "k int, n int, t string")
    assert {(r.n, r.t, r.from_raw) for r in rounds.backfilled(found, raw, ["k", "n"]).collect()} == {(2, "said", False), (3, "raw", True)}


def test_typed_answers_are_rows_with_errors(spark):
    said = {"1": '{"answers": [{"number": 1, "letter": "A"}, {"number": 0, "letter": "B"}, {"number": 2, "letter": "E"}]}', "2": "nothing", "3": None, "4": '{"other": 1}', "5": '{"answers": []}', "6": "[1]"}
    rows = spark.createDataFrame([(k, k) for k in said], "key string, text string")
    calls = tasks.asked([tasks.ANSWER_KEY.requests(rows, "key"), tasks.PART.requests(rows.withColumn("part_number", F.lit(3)), "key")], lambda ps: [said[p["input"]["text"]] if p["task"] == "answer_key" else '{"partNumber": 9}' for p in map(json.loads, ps)], tries=1)
    got = sorted((r.key, r.item.number if r.item else None, r.error) for r in tasks.ANSWER_KEY.answers(calls).collect())
    assert sorted(got, key=str) == sorted([("1", 1, None), ("1", 0, "number"), ("1", 2, "letter"), ("2", None, "not JSON"), ("3", None, "no answer"), ("4", None, "shape"), ("6", None, "shape")], key=str)
    assert {r.error for r in tasks.PART.answers(calls).collect()} == {"part number"}


def test_moves_of_a_job(spark):
    start = datetime(2024, 1, 1)
    at = lambda m: start + timedelta(minutes=m)
    rows = [(1, at(0), "QUEUED"), (1, at(1), "EXTRACTING"), (1, at(2), "DONE"), (1, at(3), "CLASSIFYING"), (1, at(60), "IMPORTING"), (1, at(61), "DONE"), (1, at(62), "IMPORTING"), (2, at(5), "DONE"), (3, at(7), "QUEUED")]
    found = jobs.moves(spark.createDataFrame(rows, "job_id long, at timestamp, wanted string"), until=F.lit(at(100)))
    got = [(r.job_id, (r.at - start).total_seconds() / 60, r.before, r.after, r.accepted, r.reason) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {
        (1, 0, None, "QUEUED", True, None), (1, 1, "QUEUED", "EXTRACTING", True, None), (1, 2, "EXTRACTING", "EXTRACTING", False, "not allowed"), (1, 3, "EXTRACTING", "CLASSIFYING", True, None),
        (1, 33, "CLASSIFYING", "FAILED", True, "timeout"), (1, 60, "FAILED", "IMPORTING", True, None), (1, 61, "IMPORTING", "DONE", True, None), (1, 62, "DONE", "DONE", False, "not allowed"),
        (2, 5, None, None, False, "not allowed"), (3, 7, None, "QUEUED", True, None), (3, 37, "QUEUED", "FAILED", True, "timeout"),
    }


def test_the_stream_is_the_batch_and_a_restart_adds_nothing(spark, tmp_path):
    dice, now = random.Random(2), datetime(2024, 1, 1)
    rows, schema = [], "job_id long, at timestamp, wanted string"
    for _ in range(240):
        now += timedelta(minutes=dice.choice([1, 2, 9]))
        rows.append((dice.randrange(5), now, dice.choice([s for s in jobs.FOLLOWS if s])))
    files, out = tmp_path / "events", f"file://{tmp_path}/out"

    def add(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{files}")

    def run():
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{files}")
        jobs.stream(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    add(rows[:90])
    add(rows[90:150])
    run()
    run()
    add(rows[150:])
    run()
    want = jobs.moves(spark.createDataFrame(rows, schema), until=F.lit(rows[-1][1])).collect()
    got = spark.read.parquet(out).collect()
    assert len(got) == len(set(got)) and set(got) == set(want)
    assert {r.reason for r in got} == {None, "not allowed", "timeout"}

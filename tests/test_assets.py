"""Images of question groups: calls, failures and what a group shows."""

import collections
import os

from quizmill.plans import assets

GROUPS = "doc_id long, part_number int, group_no int, page int, pages array<int>, box struct<x:double,y:double,w:double,h:double>, questions array<int>, passage string"
FULL, OWN = (0.0, 0.0, 1.0, 1.0), (0.1, 0.1, 0.5, 0.5)


def tables(spark, rows):
    groups = spark.createDataFrame(rows, GROUPS)
    return groups, spark.createDataFrame([(1, bytearray(b"one"), 9), (2, bytearray(b"two"), 200)], "doc_id long, content binary, pages int")


def fakes(folder):
    """Stand-ins that leave a line in a file for each call."""

    def note(name):
        with open(f"{folder}/{name}-{os.getpid()}", "a") as out:
            out.write("x\n")

    def render(content, page):
        note(f"render-{content.decode()}-{page}")
        if page == 3:
            raise OSError("page 3")
        return content + b"/%d" % page

    def scan(image):
        note(f"scan-{image.decode().replace('/', '-')}")
        if b"/4" in image:
            raise OSError("no words")
        return [{"id": "w", "text": "word", "x": 0.2, "y": 0.2, "w": 0.1, "h": 0.1}]

    def clip(image, box):
        if box["x"] > 0.85:
            raise OSError("box")
        return image + b"#%d" % round(100 * box["x"])

    return render, scan, clip


def calls(folder, start):
    found = collections.Counter()
    for name in os.listdir(folder):
        if name.startswith(start):
            with open(f"{folder}/{name}") as f:
                found[name[len(start) :].rpartition("-")[0]] += len(f.readlines())
    return found


def test_each_page_is_rendered_once_and_failures_stay_rows(spark, tmp_path):
    rows = [
        (1, 1, 0, 2, None, OWN, [1], None), (1, 1, 1, 2, None, (0.9, 0.5, 0.1, 0.1), [2], None), (1, 2, 0, 2, None, OWN, [7], None), (1, 3, 0, 3, None, OWN, [32], None),
        (1, 5, 0, 5, None, FULL, [101], None), (1, 6, 0, 4, [4], OWN, [131], None), (1, 7, 0, 4, [4, 3, 5, 4], FULL, [147], None), (1, 7, 1, None, [5], (0.5, 0.5, 0.3, 0.3), [150], None),
        (1, 7, 2, 10, None, OWN, [153], None), (2, 7, 0, None, None, OWN, [147], None), (2, 7, 1, 150, [150, 151], FULL, [147], None), (2, 4, 0, 7, None, None, [71], None),
    ]
    groups, documents = tables(spark, rows)
    calls_at, pages_at = tmp_path / "calls", tmp_path / "pages"
    calls_at.mkdir()
    render, scan, clip = fakes(calls_at)
    found = assets.prepared(groups, documents, str(pages_at), render, clip, scan).collect()
    assert calls(calls_at, "render-") == {f"{d}-{p}": 1 for d, p in [("one", 2), ("one", 3), ("one", 4), ("one", 5), ("two", 7), ("two", 150), ("two", 151)]}
    got = {(r.doc_id, r.part_number, r.group_no, r.place): r for r in found}
    assert len(got) == len(found)
    image = {k: None if r.image is None else r.image.decode() for k, r in got.items()}
    assert image == {
        (1, 1, 0, 0): "one/2#10", (1, 1, 1, 0): None, (1, 3, 0, 0): None, (1, 6, 0, 0): "one/4#10", (1, 7, 0, 0): "one/4", (1, 7, 0, 1): None, (1, 7, 0, 2): "one/5", (1, 7, 1, 0): "one/5#50",
        (1, 7, 2, 0): None, (2, 7, 1, 0): "two/150", (2, 7, 1, 1): "two/151", (2, 4, 0, 0): None,
    }
    assert {k: r.error for k, r in got.items() if r.error} == {(1, 1, 1, 0): "clip: box", (1, 3, 0, 0): "render: page 3", (1, 7, 0, 1): "render: page 3", (1, 7, 2, 0): "no such page", (2, 4, 0, 0): "no box"}
    assert got[1, 1, 0, 0].question_number == 1 and got[1, 7, 0, 2].regions[0].text == "word"
    # Page 4 has no words (its scan failed) and neither has the crop; the crop of page 5 holds none of the page's, so it is scanned.
    assert got[1, 6, 0, 0].regions is None and got[1, 7, 1, 0].regions[0].x == 0.2
    assert calls(calls_at, "scan-")["one-5"] == 1 and calls(calls_at, "scan-")["one-5#50"] == 1 and "one-2" not in calls(calls_at, "scan-")


def test_boxes_are_detected_where_they_are_missing(spark, tmp_path):
    rows = [(1, 1, 0, 2, None, None, [1], None), (1, 7, 0, 4, [4, 5], None, [147], "text"), (1, 6, 0, 5, None, None, [131], None), (1, 3, 0, 2, None, None, [], None), (1, 4, 0, 2, None, OWN, [71], None)]
    groups, documents = tables(spark, rows)
    render, scan, clip = fakes(tmp_path)

    def detect(image, asked):
        assert asked["part_number"] != 4
        if asked["part_number"] == 6:
            raise OSError("unclear")
        return [0.0, 0.0, 1.0, 1.0] if asked["passage"] == "text" else [0.3, 0.3, 5.0, 0.2]

    found = {(r.part_number, r.place): r for r in assets.prepared(groups, documents, str(tmp_path / "p"), render, clip, scan, detect).collect()}
    assert {k: (r.image and r.image.decode(), r.error) for k, r in found.items()} == {
        (1, 0): ("one/2#30", None), (7, 0): ("one/4", None), (7, 1): ("one/5", None), (6, 0): (None, "detect: unclear"), (3, 0): (None, "no box"), (4, 0): ("one/2#10", None),
    }


def test_a_group_shows_its_first_image_and_words(spark):
    rows = [
        (1, 7, 0, None, 0, 4, True, "a", None, None), (1, 7, 0, None, 1, 5, True, "b", [("w", "x", 0.1, 0.1, 0.1, 0.1)], None), (1, 7, 0, None, 2, 6, True, None, None, "render: x"),
        (1, 1, 0, 2, 0, 2, False, "c", None, None), (1, 3, 0, None, 0, 9, False, "d", None, None), (1, 4, 0, None, 0, 9, False, None, None, "no box"),
    ]
    images = spark.createDataFrame(rows, f"doc_id long, part_number int, group_no int, question_number int, place int, page int, whole boolean, key string, regions array<{assets.REGION}>, error string")
    got = {r.part_number: r for r in assets.group_assets(images).collect()}
    assert set(got) == {1, 3, 7}
    assert got[7].image == "a" and got[7].regions[0].text == "x" and [i.key for i in got[7].images] == ["a", "b"]
    assert got[1].question_images == {2: "c"} and got[3].image == "d" and got[3].images is None
    assert assets.group_assets(images.where("false")).count() == 0


def test_rows_share_frames_up_to_bounds():
    """A frame for each page cost more than its work."""
    rows = [(k, b"x") for k in range(2500)]
    frames = list(assets._framed(iter(rows), ["k", "image"]))
    assert [len(f) for f in frames] == [1000, 1000, 500] and [r for f in frames for r in f.itertuples(index=False, name=None)] == rows
    large = list(assets._framed(iter([(k, bytes(assets.BYTES_AT_ONCE)) for k in range(3)]), ["k", "image"]))
    assert [len(f) for f in large] == [1, 1, 1]

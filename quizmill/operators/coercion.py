"""Shape-tolerant reading of parsed questions: aliases, options in any form, numbering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quizmill.functions import text as T
from quizmill.functions.numbers import clamped_box
from quizmill.model import PART_RANGES
from quizmill.operators.layout import settled

OPTION_TYPE = "array<struct<letter:string,text:string>>"
LABELLED = r"(?is)\(([A-E])\)\s*(.*?)(?=\s*\([A-E]\)|$)"


def option(raw: Column, fallback: Column) -> Column:
    """(letter, text) of ``A) text`` or bare text; null when blank."""
    s = T.trim(raw)
    pattern = r"(?i)^([A-E])\)\s*(.+)$"
    labelled = s.rlike(pattern)
    letter = F.when(labelled, F.upper(F.regexp_extract(s, pattern, 1))).otherwise(fallback)
    body = F.when(labelled, T.trim(F.regexp_extract(s, pattern, 2))).otherwise(s)
    return F.when(s != "", F.struct(letter.alias("letter"), body.alias("text")))


def labelled_options(raw: Column) -> Column:
    """Options of ``(A) x (B) y``; with fewer than two labels the whole is one option."""
    s = T.trim(raw)
    letters, texts = (F.regexp_extract_all(s, F.lit(LABELLED), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(letters, texts, lambda a, b: F.struct(F.upper(a).alias("letter"), T.trim(b).alias("text")))
    several = F.filter(pairs, lambda p: p["text"] != "")
    return F.when(F.size(letters) >= 2, several).otherwise(F.array_compact(F.array(option(raw, F.lit("A")))))


def stem(combined: Column) -> Column:
    """Question text in front of the first inline option; the whole if nothing is in front."""
    s = T.trim(combined)
    head = T.trim(F.regexp_replace(s, r"(?is)\s*\([A-E]\)\s+.*$", ""))
    return F.when(head != "", head).otherwise(s)


def aliased(variant: Column, *names: str, kind: str = "string") -> Column:
    """The first of several keys of a JSON object that is there."""
    return F.coalesce(*[F.try_variant_get(variant, f"$.{n}", kind) for n in names])


def question(variant: Column) -> Column:
    """(question_number, question_text, correct) of one question object under any of its key names."""
    number = aliased(variant, "questionNumber", "number", "question_no", kind="int")
    text = aliased(variant, "questionText", "text", "question")
    answer = F.upper(F.substring(T.trim(T.or_default(aliased(variant, "correctAnswer", "answer", "correct"), F.lit("A"))), 1, 1))
    return F.struct(number.alias("question_number"), T.or_default(text, F.concat(F.lit("Question "), F.coalesce(number.cast("string"), F.lit("?")))).alias("question_text"), answer.alias("correct"))


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def _numbered(groups: pa.Array, first: pa.Array) -> pa.Array:
    """Every missing number raises the next one by one: less the missing ones before it, the next one is a running maximum."""
    unknown, rows = -(1 << 62), []
    for lists, opens in zip(groups, first, strict=True):
        if not lists.is_valid or lists.values.null_count:
            rows.append(None)
            continue
        flat = lists.values.flatten()
        missing = flat.is_null().to_numpy(zero_copy_only=False)
        n = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(missing) - missing
        opened = opens.as_py() if opens.is_valid else unknown
        reached = np.maximum.accumulate(np.concatenate([[opened], np.where(missing, unknown, n + 1 - before)]))[:-1]
        filled = np.where(missing, before + reached, n).tolist()
        for k in np.flatnonzero(missing & (reached == unknown)).tolist():
            filled[k] = None
        ends = np.cumsum([len(x) for x in lists.values]).tolist()
        rows.append([filled[i:j] for i, j in zip([0, *ends], ends, strict=False)])
    return pa.array(rows, pa.list_(pa.list_(pa.int32())))


def with_numbers(numbers: Column, first: Column) -> Column:
    """Missing numbers (null) continue from the largest so far; ``first`` opens. Its time grows as the array's length."""
    return F.get(_numbered(F.array(numbers), first), F.lit(0))


def with_numbers_of_groups(numbers: Column, first: Column) -> Column:
    """``with_numbers`` over an array of arrays, from each into the next."""
    return _numbered(numbers, first)


def dealt(items: Column, groups: Column) -> Column:
    """Items in runs of ceil(n / groups), one run per group; later groups may stay empty."""
    size = F.greatest(F.lit(1), F.ceil(F.size(items) / groups)).cast("int")
    return F.transform(F.sequence(F.lit(0), groups - 1), lambda k: F.slice(items, k * size + 1, size))


def fenced_json(raw: Column) -> Column:
    """JSON text itself, or of the first fenced block; null when neither parses."""
    inner = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.when(inner != "", inner)))


def filled_from_raw(groups: DataFrame, raw: DataFrame) -> DataFrame:
    """Groups (key, numbers, passage) with blanks filled from raw groups that hold the same set of numbers."""
    name = lambda c: F.array_join(F.array_sort(c), ",")
    other = raw.select("key", name(F.col("numbers")).alias("name"), F.col("passage").alias("raw_passage")).groupBy("key", "name").agg(F.min("raw_passage").alias("raw_passage"))
    rows = groups.withColumn("name", name(F.col("numbers"))).join(other, ["key", "name"], "left")
    return rows.select("key", "numbers", T.or_default(F.col("passage"), F.col("raw_passage")).alias("passage"))


def options_of(variant: Column) -> Column:
    """Options of a JSON value of any shape: a labelled string, a list of strings or objects, or an object by letter."""
    text = F.try_variant_get(variant, "$", "string")
    listed = F.from_json(F.to_json(variant), "array<string>")
    of_list = F.transform(listed, lambda raw, i: _option_of(raw, F.chr(i + 65)))
    keyed = F.from_json(F.to_json(variant), "map<string,string>")
    of_map = F.transform(F.map_entries(keyed), lambda e: _option_of(e["value"], F.upper(F.substring(e["key"], 1, 1))))
    kind = F.schema_of_variant(variant)
    found = F.when(kind.startswith("ARRAY"), of_list).when(kind.startswith("OBJECT"), of_map).otherwise(labelled_options(text))
    return F.filter(found, lambda o: o.isNotNull())


def _option_of(raw: Column, fallback: Column) -> Column:
    """An option from a string, or from the JSON text of an object with letter and text under any of their names."""
    v = F.try_parse_json(F.when(raw.startswith("{"), raw))
    body = T.trim(aliased(v, "text", "optionText", "content"))
    letter = F.upper(F.substring(T.trim(T.or_default(aliased(v, "letter", "option"), fallback)), 1, 1))
    return F.when(raw.startswith("{"), F.when(body != "", F.struct(letter.alias("letter"), body.alias("text")))).otherwise(option(raw, fallback))


def questions_of(variant: Column) -> Column:
    """Questions as an array of JSON texts: from a list, one question object, or an object of objects."""
    text = F.to_json(variant)
    kind = F.schema_of_variant(variant)
    is_one = F.coalesce(aliased(variant, "questionText", "text", "question"), aliased(variant, "questionNumber", "number")).isNotNull()
    listed, keyed = F.from_json(text, "array<string>"), F.map_values(F.from_json(text, "map<string,string>"))
    return F.when(kind.startswith("ARRAY"), listed).when(is_one, F.array(text)).when(kind.startswith("OBJECT"), keyed).otherwise(F.array().cast("array<string>"))


def box_of(numbers: Column) -> Column:
    """A box from an array of four finite numbers, inside the page; null for anything else or a tiny box."""
    finite = F.forall(numbers, lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))))
    return F.when((F.size(numbers) == 4) & finite, clamped_box(*(F.get(numbers, F.lit(k)) for k in range(4))))


def group_of(raw: Column, v: Column) -> Column:
    """A group from its JSON text and the same as a variant: passage, transcript, page, pages, box and questions (JSON texts), under any of their key names.

    Anything but an object is a group without questions; an object that is itself
    a question is a group of that one. Page numbers beyond an int are left out.
    """
    asked = questions_of(F.coalesce(F.try_variant_get(v, "$.questions", "variant"), F.parse_json(F.lit("[]"))))
    is_one = F.coalesce(aliased(v, "questionText", "text", "question"), aliased(v, "questionNumber", "number")).isNotNull()
    pages = F.array_distinct(F.filter(aliased(v, "sourcePages", "pages", "pageNumbers", kind="array<double>"), lambda n: n >= 1))
    return F.struct(
        aliased(v, "passage").alias("passage"), aliased(v, "transcript", "talk").alias("transcript"), aliased(v, "sourcePage", "page", "pageNumber", kind="double").try_cast("int").alias("page"),
        F.array_distinct(F.filter(F.transform(pages, lambda n: n.try_cast("int")), lambda n: n.isNotNull())).alias("pages"), box_of(aliased(v, "imageBbox", "passageBbox", "bbox", "cropBox", kind="array<double>")).alias("box"),
        F.when((F.size(asked) > 0) | ~F.coalesce(is_one, F.lit(False)), asked).otherwise(F.array(raw)).alias("questions"),
    )


def with_flat_questions(groups: Column, flat: Column) -> Column:
    """Groups that take in questions given beside them.

    Without groups every question makes one; a lone empty group takes all; groups
    that are all empty are dealt runs of ceil(n / groups); else they stay.
    """
    empty = F.filter(groups, lambda g: F.size(g["questions"]) == 0)
    nothing = lambda name: F.lit(None).cast(_GROUP[name]).alias(name)
    own = F.transform(flat, lambda q: F.struct(*(nothing(n) for n in ("passage", "transcript", "page", "pages", "box")), F.array(q).alias("questions")))
    given = lambda g, q: F.struct(*(g[n].alias(n) for n in ("passage", "transcript", "page", "pages", "box")), q.alias("questions"))
    lone = F.transform(groups, lambda g: F.when(F.size(g["questions"]) == 0, given(g, flat)).otherwise(given(g, g["questions"])))
    runs = F.zip_with(groups, dealt(flat, F.greatest(F.lit(1), F.size(groups))), given)
    return F.when(F.size(flat) == 0, groups).when(F.size(groups) == 0, own).when(F.size(empty) == 1, lone).when(F.size(empty) == F.size(groups), runs).otherwise(groups)


_GROUP = {"passage": "string", "transcript": "string", "page": "int", "pages": "array<int>", "box": "struct<x:double,y:double,w:double,h:double>"}


def parts(rows: DataFrame, key: str = "key") -> DataFrame:
    """Questions of whole parts in any JSON shape: (key, part_number, group_no, passage, transcript, page, pages, box, question_number, question, options, error).

    ``rows`` has the key, ``raw`` (JSON text) and ``expected`` (a part number or
    null). Missing question numbers continue from the largest so far, from the
    part's first on. A part that is no object, or whose number is not 1 to 7 (or beyond
    an int), gives one row with its error; a part without questions gives none.
    """
    v = F.try_parse_json(F.col("raw"))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    number = F.coalesce(F.try_variant_get(v, "$.partNumber", "double"), F.col("expected").cast("double")).try_cast("int")
    error = F.when(~is_object, "not an object").when(number.isNull() | ~number.between(1, 7), "part number")
    found = F.coalesce(F.try_variant_get(v, "$.groups", "variant"), F.try_variant_get(v, "$.group", "variant"))
    listed = F.when(F.schema_of_variant(found).startswith("ARRAY"), F.from_json(F.to_json(found), "array<string>")).when(found.isNotNull(), F.array(F.to_json(found)))
    flat = questions_of(F.coalesce(F.try_variant_get(v, "$.questions", "variant"), F.parse_json(F.lit("[]"))))
    out = rows.select(key, number.alias("part_number"), error.alias("error"), F.coalesce(listed, F.array().cast("array<string>")).alias("_listed"), flat.alias("_flat"))
    good = out.where("error is null").drop("error")
    good = settled(good, _listed=F.transform("_listed", lambda raw: F.struct(raw.alias("raw"), F.try_parse_json(raw).alias("v"))), _flat=F.col("_flat"))
    good = settled(good, _listed=F.transform("_listed", lambda z: group_of(z["raw"], z["v"])))
    good = settled(good, _groups=with_flat_questions(F.col("_listed"), F.col("_flat"))).drop("_listed", "_flat")
    first = F.create_map(*[F.lit(x) for p, (a, _, _) in PART_RANGES.items() for x in (p, a)])
    numbers = F.transform("_groups", lambda g: F.transform(F.transform(g["questions"], lambda q: question(F.try_parse_json(q))["question_number"]), lambda n: F.when(n >= 1, n)))
    good = good.withColumn("_numbers", with_numbers_of_groups(numbers, F.coalesce(first[F.col("part_number")], F.lit(1))))
    # Each group takes its own numbers along: a part's arrays are copied to none of its rows.
    asked = lambda g, n: F.zip_with(g["questions"], n, lambda q, k: F.struct(q.alias("raw"), k.alias("number")))
    each = F.zip_with("_groups", "_numbers", lambda g, n: F.struct(*(g[name].alias(name) for name in _GROUP), asked(g, n).alias("asked")))
    good = good.select(key, "part_number", F.posexplode(each).alias("group_no", "_group"))
    good = good.select(key, "part_number", "group_no", *(F.col(f"_group.{n}").alias(n) for n in _GROUP), F.explode("_group.asked").alias("_q")).withColumn("_raw", F.col("_q.raw"))
    value = F.try_parse_json(F.col("_raw"))
    good = good.select(
        key, "part_number", "group_no", *_GROUP, F.col("_q.number").alias("question_number"), question(value).alias("question"),
        options_of(F.coalesce(F.try_variant_get(value, "$.options", "variant"), F.parse_json(F.lit("[]")))).alias("options"), F.lit(None).cast("string").alias("error"),
    )
    return good.unionByName(out.where("error is not null").select(key, "part_number", "error"), allowMissingColumns=True)


def valid_regions(regions: Column) -> Column:
    """Regions (id, text, bbox array) with an id, text, and four numbers in 0..1; text trimmed."""
    good = F.filter(regions, lambda r: (r["id"] != "") & (T.trim(r["text"]) != "") & (F.size(r["bbox"]) == 4) & F.forall(r["bbox"], lambda n: n.isNotNull() & (n >= 0) & (n <= 1)))
    return F.transform(good, lambda r: F.struct(r["id"].alias("id"), T.trim(r["text"]).alias("text"), r["bbox"].alias("bbox")))


def raw_to_parsed(raw_options: Column, answer: Column) -> Column:
    """(options, correct): four lettered options with dashes for blanks; a missing answer becomes A."""
    four = T.padded(F.transform(raw_options, lambda o: T.or_default(o, F.lit("-"))), 4)
    lettered = F.transform(four, lambda o, i: F.struct(F.chr(i + 65).alias("letter"), o.alias("text")))
    return F.struct(lettered.alias("options"), F.upper(T.or_default(answer, F.lit("A"))).alias("correct"))


def picked_part(variant: Column, part: Column) -> Column:
    """The JSON text of the part with the number asked for, else of the only element; null otherwise."""
    items = F.from_json(F.to_json(variant), "array<string>")
    mine = F.filter(items, lambda raw: F.try_variant_get(F.try_parse_json(raw), "$.partNumber", "int") == part)
    return F.coalesce(F.get(mine, 0), F.when(F.size(items) == 1, F.get(items, 0)))

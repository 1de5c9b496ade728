"""Numbers, boxes and skills."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizmill.model import LEAST_BOX, LISTENING_PARTS, PART_RANGES, READING_PARTS


def half_up(c: Column) -> Column:
    """Rounds halves toward plus infinity."""
    return F.floor(c + 0.5)


def clamp(c: Column, low, high) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(low, F.least(high, c))


def number_or_null(c: Column) -> Column:
    """A finite number, else null."""
    n = c.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < F.lit(float("inf"))), n)


def skill(part: Column) -> Column:
    return F.when(part.isin(*LISTENING_PARTS), "listening").when(part.isin(*READING_PARTS), "reading")


def part_of_number(number: Column) -> Column:
    out = F.lit(None).cast("int")
    for part, (first, last, _) in PART_RANGES.items():
        out = F.when(number.between(first, last), part).otherwise(out)
    return out


def clamped_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The box inside the page; null when its width or height falls under the least."""
    cx, cy = clamp(x, 0.0, 1.0), clamp(y, 0.0, 1.0)
    cw, ch = clamp(w, 0.0, 1 - cx), clamp(h, 0.0, 1 - cy)
    return F.when((cw >= LEAST_BOX) & (ch >= LEAST_BOX), F.struct(cx.alias("x"), cy.alias("y"), cw.alias("w"), ch.alias("h")))


def raised_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The box inside the page, its width and height raised to the least."""
    cx, cy = clamp(x, 0.0, 1.0), clamp(y, 0.0, 1.0)
    least = F.lit(LEAST_BOX)
    return F.struct(cx.alias("x"), cy.alias("y"), F.greatest(least, F.least(1 - cx, w)).alias("w"), F.greatest(least, F.least(1 - cy, h)).alias("h"))


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes (structs x, y, w, h) share."""
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def overlap_share(region: Column, crop: Column) -> Column:
    """Part of the region that lies in the crop; 0 for a region without area."""
    area = region["w"] * region["h"]
    return F.when(area > 0, overlap(region, crop) / area).otherwise(0.0)


def remapped(region: Column, crop: Column) -> Column:
    """The region in the crop's coordinates; null when fully outside."""
    x, y = (region["x"] - crop["x"]) / crop["w"], (region["y"] - crop["y"]) / crop["h"]
    w, h = region["w"] / crop["w"], region["h"] / crop["h"]
    inside = (x + w > 0) & (y + h > 0) & (x < 1) & (y < 1)
    least, zero = F.lit(0.001), F.lit(0.0)
    box = F.struct(
        clamp(x, 0.0, 1.0).alias("x"), clamp(y, 0.0, 1.0).alias("y"),
        F.greatest(least, F.least(1 - F.greatest(zero, x), w)).alias("w"), F.greatest(least, F.least(1 - F.greatest(zero, y), h)).alias("h"),
    )
    return F.when(inside, box)


def normalised_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box in parts of its page from corners in the page's units, inside 0..1; all zero for a page without size."""
    empty = (width <= 0) | (height <= 0)
    part = lambda a, whole: F.when(empty, 0.0).otherwise(clamp(a / whole, 0.0, 1.0))
    return F.struct(part(x0, width).alias("x"), part(y0, height).alias("y"), part(x1 - x0, width).alias("w"), part(y1 - y0, height).alias("h"))


def united(a: Column, b: Column) -> Column:
    """The smallest box around two boxes."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x).alias("w"), (F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y).alias("h"))


def centre_x(box: Column) -> Column:
    return box["x"] + box["w"] / 2


def in_column(box: Column, side: Column, split: Column) -> Column:
    """Whether a box's centre is in a column (left, right, or single: everywhere)."""
    return F.when(side == "left", centre_x(box) < split).when(side == "right", centre_x(box) >= split).otherwise(True)


def time_or_null(text: Column) -> Column:
    """A time from its text; null for no text and for text that is none."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def millis(at: Column) -> Column:
    """Milliseconds since 1970 of a time."""
    return F.unix_millis(at)

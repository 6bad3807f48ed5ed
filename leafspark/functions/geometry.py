"""Rectangles of selections and annotations, in 32-bit floats as the pages' coordinates are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RECT = "struct<left: float, top: float, right: float, bottom: float>"
NOTE_SIZE, PAGE_HEIGHT = 22.0, 792.0


def f32(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def rect(left, top, right, bottom) -> Column:
    return F.struct(f32(left).alias("left"), f32(top).alias("top"), f32(right).alias("right"), f32(bottom).alias("bottom"))


def normalized(r: Column) -> Column:
    return rect(F.least(r["left"], r["right"]), F.least(r["top"], r["bottom"]), F.greatest(r["left"], r["right"]), F.greatest(r["top"], r["bottom"]))


def width(r: Column) -> Column:
    return r["right"] - r["left"]


def height(r: Column) -> Column:
    return r["bottom"] - r["top"]


def usable(r: Column) -> Column:
    return (width(r) > 0) & (height(r) > 0)


def usable_rects(rects: Column) -> Column:
    """The rectangles that have an area, upright."""
    return F.filter(F.transform(rects, normalized), usable)


def union(rects: Column) -> Column:
    """The box around rectangles; null around none."""
    ends = (F.array_min(F.transform(rects, lambda r: r["left"])), F.array_min(F.transform(rects, lambda r: r["top"])), F.array_max(F.transform(rects, lambda r: r["right"])), F.array_max(F.transform(rects, lambda r: r["bottom"])))
    return F.when(F.size(rects) > 0, rect(*ends))


def page_height(media_box: Column) -> Column:
    """From a media box as an array of four; a usual height where it makes no sense."""
    high = F.coalesce(f32(F.get(media_box, F.lit(3))), f32(PAGE_HEIGHT)) - F.coalesce(f32(F.get(media_box, F.lit(1))), f32(0))
    return F.when(high > 0, high).otherwise(f32(PAGE_HEIGHT))


def flipped(r: Column, page: Column) -> Column:
    """From the top-left space to the page's, as an array of four."""
    return F.array(r["left"], page - r["bottom"], r["right"], page - r["top"])


def quad_points(rects: Column, page: Column) -> Column:
    """Top left, top right, bottom left, bottom right of each rectangle in turn."""
    return F.flatten(F.transform(rects, lambda r: F.array(r["left"], page - r["top"], r["right"], page - r["top"], r["left"], page - r["bottom"], r["right"], page - r["bottom"])))


def clamp_color(value: Column) -> Column:
    return F.least(F.greatest(f32(value), f32(0)), f32(1))


def destination_page(index: Column, pages: Column) -> Column:
    """A page index within a document; null for a negative one or without pages."""
    return F.when((pages > 0) & (index >= 0), F.least(index, pages - 1))


def word_steps(fragment: str, left: str, right: str, press_y: str) -> list[dict[str, Column]]:
    """Columns to add in turn for word, a selected word's rectangle, with a line's height rather than its fragment's.
    Null for a fragment narrower than one, for which no width is right. The columns before it begin with _w."""
    c, one = F.col, f32(1)
    side = lambda name: F.col(f"_wbox.{name}")
    finite = ~F.isnan(c("_wpress")) & (F.abs(c("_wpress")) < f32(float("inf")))
    return [
        {"_wbox": normalized(c(fragment)), "_wleft": f32(c(left)), "_wright": f32(c(right)), "_wpress": f32(c(press_y))},
        {"_wwide": F.greatest(width(c("_wbox")), one), "_wtall": F.greatest(height(c("_wbox")), one)},
        {"_wleast": F.greatest(F.least(f32(18), c("_wwide")), one)},
        {"_wstart": F.least(F.greatest(F.least(c("_wleft"), c("_wright") - one), side("left")), F.greatest(side("right") - c("_wleast"), side("left")))},
        {"_wend": F.least(F.greatest(c("_wright"), c("_wstart") + c("_wleast"), c("_wstart") + one), side("right"))},
        {"_wnatural": F.least(F.greatest(f32(8), F.least(f32(20), F.greatest(c("_wend") - c("_wstart"), one) * f32(0.45), c("_wtall") * f32(0.42))), c("_wtall"))},
        {"_wmiddle": F.when(finite, F.least(F.greatest(c("_wpress"), side("top")), side("bottom"))).otherwise((side("top") + side("bottom")) / f32(2))},
        {"_wtop": F.least(F.greatest((c("_wmiddle") - c("_wnatural") / f32(2)).cast("float"), side("top")), side("bottom") - c("_wnatural")), "_wtight": (c("_wtall") > 18) & (c("_wtall") > c("_wnatural") * f32(1.15))},
        {
            "word": F.when(
                c("_wstart") + one <= side("right"),
                rect(c("_wstart"), F.when(c("_wtight"), c("_wtop")).otherwise(side("top")), c("_wend"), F.when(c("_wtight"), c("_wtop") + c("_wnatural")).otherwise(side("bottom"))),
            )
        },
    ]

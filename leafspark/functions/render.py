"""Render sizing: which widths, heights and tiles a page is drawn at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE, LEAST, MOST, FALLBACK, PREVIEW = 1.25, 720, 2200, 360, 220
MAX_PIXELS, MAX_SIDE = 8_000_000, 4096
BUCKETS = (PREVIEW, 720, 1080, 1440, 1800, MOST)
FALLBACKS = (0.85, 0.7, 0.55, 0.4)
# Reasons to render, most urgent first.
REASONS = ("VISIBLE", "VISIBLE_HIGH_RES", "ADJACENT_PREFETCH", "IDLE_PREFETCH", "BACKGROUND_METADATA")


def _float(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def _round(value: Column) -> Column:
    """Half up, as a long."""
    return F.floor(value.cast("double") + 0.5)


def _between(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def bucket_width(width: Column) -> Column:
    """The least bucket of at least this width, or the largest."""
    out = None
    for b in BUCKETS[:-1]:
        test = F.greatest(width, F.lit(1)) <= b
        out = F.when(test, b) if out is None else out.when(test, b)
    return F.when(width.isNotNull(), out.otherwise(BUCKETS[-1])).cast("int")


def target_width(content: Column) -> Column:
    """The bucket to render for a view of so many pixels; null for none."""
    asked = _between(_round(_float(content) * _float(SCALE)), FALLBACK, MOST)
    steps = F.floor((asked + 63) / 128) * 128
    return F.when(content > 0, bucket_width(_between(steps, LEAST, MOST)))


def fallback_widths(width: Column) -> Column:
    """Widths to try in turn, each once and none above the first."""
    first = F.greatest(width, F.lit(1)).cast("int")
    others = [F.greatest(_round(_float(first) * _float(f)), F.lit(FALLBACK)).cast("int") for f in FALLBACKS]
    return F.filter(F.array_distinct(F.array(first, *others, F.lit(FALLBACK))), lambda w: w <= first)


def safe_dimensions(asked: Column, page_width: Column, page_height: Column) -> Column:
    """struct(width, height) within MAX_SIDE and MAX_PIXELS, of the page's shape; null if there is none. One step down
    is enough where rounding the height up takes the pixels over."""
    ratio = page_height.cast("double") / F.when(page_width > 0, page_width).cast("double")
    floor = lambda v: F.greatest(F.least(v, F.lit(2.0**31 - 1)).cast("int"), F.lit(1))
    width = F.least(_between(asked, 1, MAX_SIDE), floor(F.sqrt(F.lit(float(MAX_PIXELS)) / ratio)), floor(F.lit(float(MAX_SIDE)) / ratio))
    height = lambda w: F.greatest(_round(w * ratio), F.lit(1).cast("long"))
    width = F.when((width > 1) & (width.cast("long") * height(width) > MAX_PIXELS), width - 1).otherwise(width)
    fits = (page_width > 0) & (page_height > 0) & (height(width) <= MAX_SIDE) & (width.cast("long") * height(width) <= MAX_PIXELS)
    return F.when(fits, F.struct(width.cast("int").alias("width"), height(width).cast("int").alias("height")))


def bitmap_acceptable(bitmap: Column, target: Column) -> Column:
    return (bitmap > 0) & (target > 0) & (bitmap >= F.greatest(F.least(target, F.lit(FALLBACK)), F.lit(1)))


def clamp_tile(x: Column, y: Column, width: Column, height: Column, render_width: Column, render_height: Column) -> Column:
    """The part of a tile that lies on the page; null if none does."""

    def side(at, size, whole):
        low = _cap(at.cast("long"), F.lit(0).cast("long"), whole.cast("long"))
        return low, _cap(at.cast("long") + size.cast("long"), low, whole.cast("long"))

    sane = (width > 0) & (height > 0) & (render_width > 0) & (render_height > 0)
    (left, right), (top, bottom) = side(x, width, render_width), side(y, height, render_height)
    tile = F.struct(*(c.cast("int").alias(n) for n, c in (("x", left), ("y", top), ("width", right - left), ("height", bottom - top))))
    return F.when(sane & (right > left) & (bottom > top), tile)


def _cap(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def reason_priority(reason: Column) -> Column:
    """0 of the most urgent reason; null of an unknown one."""
    out = F.when(reason == REASONS[0], 0)
    for k, r in enumerate(REASONS[1:], 1):
        out = out.when(reason == r, k)
    return out


def request_key(page: Column, target: Column, tile: Column) -> Column:
    """What makes two requests the same: neither generation nor reason."""
    return F.struct(page.alias("page"), target.alias("target_width"), tile.alias("tile"))

"""Column functions against plain Python and known cases."""

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from leafspark.functions import geometry as geo
from leafspark.functions import render, text
from leafspark.kernels import filters, fonts, objects
from leafspark.operators import selection

f32 = np.float32


def column(spark, rows, schema, c, made=None):
    frame = spark.createDataFrame(rows, schema).coalesce(1)
    return [r[0] for r in (made(frame) if made else frame.select(c.alias("c"))).collect()]


def test_target_widths(spark):
    got = column(spark, [(w,) for w in (800, 960, 10000, 1, 0, -5, 700)], "w int", render.target_width(F.col("w")))
    assert got == [1080, 1440, 2200, 720, None, None, 1080]
    assert column(spark, [(w,) for w in (-1, 220, 221, 1800, 9999)], "w int", render.bucket_width(F.col("w"))) == [220, 220, 720, 1800, 2200]


def test_fallbacks(spark):
    got = column(spark, [(1000,), (100,), (360,), (0,)], "w int", render.fallback_widths(F.col("w")))
    assert got == [[1000, 850, 700, 550, 400, 360], [100], [360], [1]]


def plain_dimensions(asked, pw, ph):
    if pw <= 0 or ph <= 0:
        return None
    a = ph / pw
    w = min(max(1, min(asked, 4096)), max(1, int(math.sqrt(8e6 / a))), max(1, int(4096 / a)))
    h = max(1, math.floor(w * a + 0.5))
    while w > 1 and w * h > 8_000_000:
        w -= 1
        h = max(1, math.floor(w * a + 0.5))
    return None if h > 4096 or w * h > 8_000_000 else (w, h)


def test_dimensions(spark):
    r = random.Random(1)
    rows = [(r.randrange(1, 6000), r.randrange(-1, 5000), r.randrange(0, 5000)) for _ in range(4000)] + [(2000, 1, 1_000_000), (4096, 4000, 4000), (1, 1_000_000, 1)]
    got = column(spark, rows, "a int, w int, h int", render.safe_dimensions(F.col("a"), F.col("w"), F.col("h")))
    assert [None if g is None else tuple(g) for g in got] == [plain_dimensions(*x) for x in rows]


def test_tiles_and_bitmaps(spark):
    rows = [(-20, 80, 180, 200, 120, 180), (200, 0, 10, 10, 120, 180), (0, 0, 0, 5, 9, 9), (2147483647, 0, 2147483647, 5, 9, 9), (5, 5, 2147483647, 3, 9, 9)]
    got = column(spark, rows, "x int, y int, w int, h int, rw int, rh int", render.clamp_tile(*(F.col(c) for c in ("x", "y", "w", "h", "rw", "rh"))))
    assert [None if g is None else tuple(g) for g in got] == [(0, 80, 120, 100), None, None, None, (5, 5, 4, 3)]
    assert column(spark, [(360, 900), (359, 900), (100, 100), (0, 5), (5, 0)], "b int, t int", render.bitmap_acceptable(F.col("b"), F.col("t"))) == [True, False, True, False, False]
    assert column(spark, [(r,) for r in (*render.REASONS, "X")], "r string", render.reason_priority(F.col("r"))) == [0, 1, 2, 3, 4, None]


def plain_word_rect(box, left, right, press):
    l, t, r, b = min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3])
    if r - l < 1:
        return None
    wide, tall = max(f32(r - l), f32(1)), max(f32(b - t), f32(1))
    least = max(min(f32(18), wide), f32(1))
    s = min(left, f32(right - f32(1)))
    s = min(max(s, l), max(f32(r - least), l))
    if f32(s + f32(1)) > r:
        return None
    e = min(max(max(right, f32(s + least)), f32(s + f32(1))), r)
    nat = min(max(f32(8), min(f32(20), f32(max(f32(e - s), f32(1)) * f32(0.45)), f32(tall * f32(0.42)))), tall)
    if not (tall > 18 and tall > f32(nat * f32(1.15))):
        return (s, t, e, b)
    mid = min(max(press, t), b) if math.isfinite(press) else f32(f32(t + b) / f32(2))
    top = min(max(f32(mid - f32(nat / f32(2))), t), f32(b - nat))
    return (s, top, e, f32(top + nat))


def test_word_rects(spark):
    r = random.Random(3)
    rows = [tuple(float(f32(r.uniform(0, 300))) for _ in range(7)) for _ in range(2000)]
    rows += [(0.0, 0.0, 0.5, 40.0, 0.0, 0.2, 9.0), (0.0, 80.0, 200.0, 160.0, 10.0, 60.0, float("nan")), (0.0, 80.0, 200.0, 160.0, 10.0, 60.0, float("inf")), (0.0, 100.0, 200.0, 116.0, 10.0, 60.0, 105.0)]
    c = [F.col(x) for x in "abcdefg"]
    got = column(spark, rows, ", ".join(f"{x} float" for x in "abcdefg"), None, lambda d: selection.word_rects(d.select(geo.rect(*c[:4]).alias("fragment"), c[4].alias("left"), c[5].alias("right"), c[6].alias("press_y"))).select("word"))
    for row, g in zip(rows, got):
        want = plain_word_rect([f32(v) for v in row[:4]], f32(row[4]), f32(row[5]), f32(row[6]))
        assert (g is None) == (want is None) and (g is None or tuple(map(f32, g)) == tuple(map(f32, want))), row
    assert tuple(got[-1]) == (10.0, 100.0, 60.0, 116.0)


def test_boxes(spark):
    box = lambda b: geo.page_height(b)
    assert column(spark, [([0.0, 10.0, 5.0, 300.0],), ([0.0],), (None,), ([0.0, 900.0, 5.0, 300.0],), ([],)], "b array<double>", box(F.col("b"))) == [290.0, 792.0, 792.0, 792.0, 792.0]
    assert column(spark, [(5, 3), (-1, 3), (0, 0), (1, 3)], "i int, n int", geo.destination_page(F.col("i"), F.col("n"))) == [2, None, None, 1]
    assert column(spark, [(-1.0,), (0.5,), (7.0,)], "v float", geo.clamp_color(F.col("v"))) == [0.0, 0.5, 1.0]


def test_numbers_and_strings(spark):
    r = random.Random(4)
    values = [0.0, -0.0, 0.00005, -0.00009, 3.0, -7.0, 1.25, 1e15, 2.0**40 + 0.5] + [r.uniform(-1e4, 1e4) for _ in range(500)]
    assert column(spark, [(v,) for v in values], "v double", text.pdf_number(F.col("v"))) == [objects.format_number(v) for v in values]
    raw = ["", "a(b)\\c\n\r\t", "plain", "\\(", "a b#/%é{}\x01~!€"]
    assert column(spark, [(v,) for v in raw], "v string", text.escape_literal(F.col("v"))) == [objects.escape_literal(v) for v in raw]
    assert column(spark, [(v,) for v in raw], "v string", text.escape_name(F.col("v"))) == [objects.escape_name(v) for v in raw]
    assert column(spark, [(f"{objects.BLANK}x\xa0y{objects.BLANK}",)], "v string", text.trimmed(F.col("v"))) == ["x\xa0y"]


def test_codes(spark):
    every = bytes(range(256))
    for name in fonts.ENCODINGS:
        want = "".join(chr(c) for c in fonts.ENCODINGS[name] if c)
        assert column(spark, [(bytearray(every),), (bytearray(),)], "b binary", text.encoded_text(F.col("b"), name)) == [want, ""]
    names = [*fonts.GLYPHS, "uni0041", "uni00e90041", "uni12", "u0041", "u1F600", "uXYZW", "nosuch", "", "unicode"]
    assert column(spark, [(n,) for n in names], "n string", text.glyph_code(F.col("n"))) == [fonts.glyph_code(n) for n in names]
    hexes = ["48 6", "zz4>99", ">", "4A4b"]
    from leafspark.kernels.filters import ascii_hex

    assert [bytes(b) for b in column(spark, [(h,) for h in hexes], "h string", text.ascii_hex(F.col("h")))] == [ascii_hex(h.encode()) for h in hexes]
    strings = [b"\xfe\xff\x00A\x04\x16", b"\xff\xfeA\x00", b"caf\xe9", b""]
    assert column(spark, [(bytearray(s),) for s in strings], "s binary", text.text_string(F.col("s"))) == [objects.text_string(s) for s in strings]
    assert column(spark, [(bytearray(b"x" * 1019 + b"%PDF-"),), (bytearray(b"x" * 1020 + b"%PDF-"),)], "c binary", text.looks_like_pdf(F.col("c"))) == [True, False]


def test_ascii_hex_of_other_characters(spark):
    rows = ["", "4", "41 4", "\u00e941", "4\u00e91", "zz", "4>1", ">", "41>zz", "aF0", "\u20ac4", "\U0001F6004a", "\uff14\uff11", "4\n1"]
    got = spark.createDataFrame([(r,) for r in rows], "d string").select("d", text.ascii_hex(F.col("d")).alias("b")).collect()
    assert [bytes(r["b"]) for r in got] == [filters.ascii_hex(r["d"].encode("latin-1", "replace").replace(b"?", b" ")) for r in got]
    # A negated class of ranges takes more than half a microsecond a character.
    long = spark.range(1).select(F.repeat(F.lit("4a"), 1 << 24).alias("d"))
    started = time.time()
    assert long.select(F.octet_length(text.ascii_hex(F.col("d"))).alias("n")).first()["n"] == 1 << 24
    assert time.time() - started < 10

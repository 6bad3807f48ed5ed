"""Numbers, names and strings as PDF syntax has them, and strings back from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafspark.kernels.fonts import ENCODINGS, GLYPHS
from leafspark.kernels.objects import BLANK

#: What counts as blank at the ends of a text; trim() takes spaces alone.
_BLANK = "".join(f"\\x{{{ord(c):X}}}" for c in BLANK)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{_BLANK}]+|[{_BLANK}]+$", "")


def pdf_number(value: Column) -> Column:
    """At most four decimals, without trailing zeros; next to nothing is 0."""
    v = value.cast("double")
    short = F.rtrim(F.rtrim(F.format_string("%.4f", v), F.lit("0")), F.lit("."))
    whole = (v == F.floor(v)) & (F.abs(v) < 2.0**63)
    return F.when(v.isNull(), F.lit(None)).when(F.abs(v) < 0.0001, "0").when(whole, v.cast("long").cast("string")).otherwise(short)


def escape_literal(text: Column) -> Column:
    """Backslashes first, then parentheses and line ends."""
    for raw, escaped in (("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def escape_name(text: Column) -> Column:
    """Regular printable characters as they are, others as # and two or more digits."""
    code = lambda c: F.hex(F.ascii(c))
    shown = lambda c: F.when(c.rlike(r"^[!-~&&[^#/%()<>\[\]{}]]$"), c).otherwise(F.concat(F.lit("#"), F.when(F.length(code(c)) < 2, F.lpad(code(c), 2, "0")).otherwise(code(c))))
    return F.when(text == "", text).otherwise(F.array_join(F.transform(F.split(text, ""), shown), ""))


def text_string(data: Column) -> Column:
    """A string object's bytes as text: UTF-16 by its byte order mark, else Latin-1."""
    mark = F.hex(F.substring(data, 1, 2))
    rest = F.substring(data, 3, 1 << 30)
    return F.when(mark == "FEFF", F.decode(rest, "UTF-16BE")).when(mark == "FFFE", F.decode(rest, "UTF-16LE")).otherwise(F.decode(data, "ISO-8859-1"))


def encoded_text(data: Column, encoding: str = "WinAnsiEncoding") -> Column:
    """Bytes in a named encoding as text; codes that it lacks are dropped."""
    # As Latin-1 every byte is the character of its number; then the codes that differ are changed, the others dropped.
    codes = [(code, point) for code, point in enumerate(ENCODINGS[encoding]) if code != point or not code]
    changed, dropped = [(code, point) for code, point in codes if point], [code for code, point in codes if not point]
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(chr(c) for c in (*(c for c, _ in changed), *dropped)), "".join(chr(p) for _, p in changed))


def glyph_code(glyph: Column) -> Column:
    """The code point of a glyph name; null of an unknown one."""
    known = F.create_map(*(x for k, v in GLYPHS.items() for x in (F.lit(k), F.lit(v))))
    hexadecimal = lambda h: F.when(h.rlike("^[0-9A-Fa-f]+$"), F.conv(h, 16, 10).cast("int"))
    uni = F.when(glyph.startswith("uni") & (F.length(glyph) >= 7) & (F.length(glyph) % 4 == 3), hexadecimal(F.substring(glyph, 4, 4)))
    short = F.when(glyph.startswith("u") & F.length(glyph).between(5, 7), hexadecimal(F.substring(glyph, 2, 6)))
    has_uni = glyph.startswith("uni") & (F.length(glyph) >= 7) & (F.length(glyph) % 4 == 3)
    return F.coalesce(F.try_element_at(known, glyph), F.when(has_uni, uni).otherwise(short))


def ascii_hex(data: Column) -> Column:
    """ASCII hexadecimal data (a string) as bytes: other characters are ignored, > ends it, an odd digit gets a 0."""
    # The class is one of ASCII; written as ranges it takes some seven times as long.
    digits = F.regexp_replace(F.split_part(data, F.lit(">"), F.lit(1)), r"[^\p{XDigit}]+", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def looks_like_pdf(content: Column) -> Column:
    """The header within the first 1024 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0

"""From character codes to text: encodings, glyph names, ToUnicode maps."""

from __future__ import annotations

import re
import struct
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property

from leafspark.kernels.objects import NULL, Name, Ref, name

#: Ranges of more codes are kept as ranges and looked up in; shorter ones are spelled out.
SPELLED = 256


def _codec(codec: str, high: range) -> list[int]:
    """Printable ASCII as it is, and what a codec has in a high range; 0 where there is nothing."""
    out = [c if 0x20 <= c <= 0x7E else 0 for c in range(256)]
    for c in high:
        try:
            out[c] = ord(bytes([c]).decode(codec))
        except UnicodeDecodeError:
            pass
    return out


ENCODINGS = {
    "WinAnsiEncoding": _codec("cp1252", range(0x80, 0x100)),
    "MacRomanEncoding": _codec("mac_roman", range(0x80, 0x100)),
    "StandardEncoding": _codec("ascii", range(0)),
    "PDFDocEncoding": _codec("latin-1", range(0xA1, 0x100)),
}
# The accents at 0x18 to 0x1F of PDFDocEncoding.
ENCODINGS["PDFDocEncoding"][0x18:0x20] = [0x02D8, 0x02C7, 0x02C6, 0x02D9, 0x02DD, 0x02DB, 0x02DA, 0x02DC]

# Glyph names and their code points that no rule below gives.
_NAMED = {
    "space": 0x0020, "exclam": 0x0021, "quotedbl": 0x0022, "numbersign": 0x0023, "dollar": 0x0024, "percent": 0x0025,
    "ampersand": 0x0026, "parenleft": 0x0028, "parenright": 0x0029, "asterisk": 0x002A, "plus": 0x002B, "comma": 0x002C,
    "hyphen": 0x002D, "period": 0x002E, "slash": 0x002F, "colon": 0x003A, "semicolon": 0x003B, "less": 0x003C, "equal": 0x003D,
    "greater": 0x003E, "question": 0x003F, "at": 0x0040, "bracketleft": 0x005B, "backslash": 0x005C, "bracketright": 0x005D,
    "asciicircum": 0x005E, "underscore": 0x005F, "braceleft": 0x007B, "bar": 0x007C, "braceright": 0x007D,
    "asciitilde": 0x007E, "nobreakspace": 0x00A0, "exclamdown": 0x00A1, "cent": 0x00A2, "sterling": 0x00A3, "currency": 0x00A4,
    "yen": 0x00A5, "brokenbar": 0x00A6, "section": 0x00A7, "dieresis": 0x00A8, "copyright": 0x00A9, "ordfeminine": 0x00AA,
    "guillemotleft": 0x00AB, "logicalnot": 0x00AC, "softhyphen": 0x00AD, "registered": 0x00AE, "macron": 0x00AF,
    "degree": 0x00B0, "plusminus": 0x00B1, "twosuperior": 0x00B2, "threesuperior": 0x00B3, "acute": 0x00B4, "mu": 0x00B5,
    "paragraph": 0x00B6, "periodcentered": 0x00B7, "cedilla": 0x00B8, "onesuperior": 0x00B9, "ordmasculine": 0x00BA,
    "guillemotright": 0x00BB, "onequarter": 0x00BC, "onehalf": 0x00BD, "threequarters": 0x00BE, "questiondown": 0x00BF,
    "AE": 0x00C6, "Eth": 0x00D0, "multiply": 0x00D7, "Thorn": 0x00DE, "germandbls": 0x00DF, "ae": 0x00E6, "eth": 0x00F0,
    "divide": 0x00F7, "thorn": 0x00FE, "OE": 0x0152, "oe": 0x0153, "florin": 0x0192, "circumflex": 0x02C6, "caron": 0x02C7,
    "breve": 0x02D8, "dotaccent": 0x02D9, "ring": 0x02DA, "ogonek": 0x02DB, "tilde": 0x02DC, "hungarumlaut": 0x02DD,
    "Omega": 0x03A9, "pi": 0x03C0, "endash": 0x2013, "emdash": 0x2014, "quoteleft": 0x2018, "quoteright": 0x2019,
    "quotesinglbase": 0x201A, "quotedblleft": 0x201C, "quotedblright": 0x201D, "quotedblbase": 0x201E, "dagger": 0x2020,
    "daggerdbl": 0x2021, "bullet": 0x2022, "ellipsis": 0x2026, "perthousand": 0x2030, "guilsinglleft": 0x2039,
    "guilsinglright": 0x203A, "fraction": 0x2044, "Euro": 0x20AC, "trademark": 0x2122, "partialdiff": 0x2202, "Delta": 0x2206,
    "Pi": 0x220F, "summation": 0x2211, "minus": 0x2212, "radical": 0x221A, "infinity": 0x221E, "integral": 0x222B,
    "approxequal": 0x2248, "notequal": 0x2260, "lessequal": 0x2264, "greaterequal": 0x2265, "lozenge": 0x25CA, "fi": 0xFB01,
    "fl": 0xFB02, "ffi": 0xFB03, "ffl": 0xFB04,
}
_ACCENTS = {"GRAVE": "grave", "ACUTE": "acute", "CIRCUMFLEX": "circumflex", "TILDE": "tilde", "DIAERESIS": "dieresis", "RING ABOVE": "ring", "CEDILLA": "cedilla", "STROKE": "slash", "CARON": "caron"}


def _glyphs() -> dict[str, int]:
    out = _NAMED | {chr(c): c for c in range(128) if chr(c).isalnum()}
    for c in (*range(0xC0, 0x100), 0x160, 0x161, 0x178, 0x17D, 0x17E):  # accented letters by their Unicode names
        m = re.fullmatch(r"LATIN (CAPITAL|SMALL) LETTER ([A-Z]) WITH (.+)", unicodedata.name(chr(c)))
        if m and m[3] in _ACCENTS:
            out[(m[2] if m[1] == "CAPITAL" else m[2].lower()) + _ACCENTS[m[3]]] = c
    return out


GLYPHS = _glyphs()
_HEX = re.compile(r"[+-]?[0-9A-Fa-f]+\Z")


def _hex(digits: str) -> int | None:
    value = int(digits, 16) if _HEX.match(digits) else None
    return value if value is not None and -(1 << 31) <= value < 1 << 31 else None


def glyph_code(glyph: str) -> int | None:
    """The code point of a glyph name: by name, by "uni" and four digits, or by "u" and four to six."""
    if glyph in GLYPHS:
        return GLYPHS[glyph]
    if glyph.startswith("uni") and len(glyph) >= 7 and len(glyph) % 4 == 3:
        return _hex(glyph[3:7])
    return _hex(glyph[1:]) if glyph.startswith("u") and 5 <= len(glyph) <= 7 else None


@dataclass
class CMap:
    """Targets of one-byte and of longer codes, and the width of the code space."""

    single: Targets = field(default_factory=lambda: Targets())
    double: Targets = field(default_factory=lambda: Targets())
    width: int = 1

    def get(self, code: int, width: int) -> str | None:
        first, second = (self.single, self.double) if width == 1 else (self.double, self.single)
        got = first.get(code)
        return second.get(code) if got is None else got


class Targets:
    """The targets of codes. What is set later hides what is set earlier."""

    def __init__(self):
        self._codes: dict[int, tuple[int, str]] = {}
        self._ranges: list[tuple[int, int, int, int]] = []

    def set(self, code: int, target: str) -> None:
        self._codes[code] = (len(self._ranges), target)

    def set_range(self, first: int, last: int, start: int) -> None:
        """Codes first to last, for code points from start on. Raises ValueError for a range that runs beyond Unicode."""
        if first > last:
            return
        if start + last - first > 0x10FFFF:
            raise ValueError("beyond Unicode")
        if last - first < SPELLED:
            for code in range(first, last + 1):
                self.set(code, _point(start + code - first))
        else:
            self._ranges.append((first, last, start, len(self._ranges) + 1))

    def get(self, code: int) -> str | None:
        after, target = self._codes.get(code, (0, None))
        for first, last, start, k in reversed(self._ranges):
            if k <= after:
                break
            if first <= code <= last:
                return _point(start + code - first)
        return target

    def all(self) -> dict[int, str]:
        """All codes with their targets."""
        codes = dict.fromkeys(c for first, last, _, _ in self._ranges for c in range(first, last + 1))
        return {c: self.get(c) for c in (codes | dict.fromkeys(self._codes))}


_SPACES = re.compile(r"begincodespacerange(.*?)endcodespacerange", re.S)
_CHARS = re.compile(r"beginbfchar(.*?)endbfchar", re.S)
_RANGES = re.compile(r"beginbfrange(.*?)endbfrange", re.S)
_LITERAL = re.compile(r"<([0-9A-Fa-f]+)>")
_RANGE_TOKEN = re.compile(r"<([^>]*)>|\[([^\]]*)\]")


def target_text(digits: str) -> str:
    """Hexadecimal UTF-16 units as text; nothing for an odd number of digits."""
    if len(digits) % 2:
        return ""
    units = [int(digits[k : k + 4], 16) for k in range(0, len(digits), 4)]
    return b"".join(u.to_bytes(2, "big") for u in units if u).decode("utf-16-be", "surrogatepass") if any(units) else ""


def _point(code: int) -> str:
    return chr(code) if code > 0 else ""


def parse_cmap(data: bytes) -> CMap:
    """A ToUnicode map. Raises ValueError where a range runs beyond Unicode: then the whole map counts for nothing."""
    text, out = data.decode("latin-1"), CMap()
    space = _SPACES.search(text)
    if space and (codes := _LITERAL.findall(space[1])):
        out.width = min(4, max(1, len(codes[0]) // 2))
    for section in _CHARS.findall(text):
        found = _LITERAL.findall(section)
        for code, target in zip(found[::2], found[1::2]):
            at = _hex(code) if code else None
            if at is None:
                break
            (out.single if max(1, len(code) // 2) == 1 else out.double).set(at, target_text(target))
    for section in _RANGES.findall(text):
        tokens = [("[", m[2]) if m[2] is not None else ("<", m[1]) for m in _RANGE_TOKEN.finditer(section)]
        at = 0
        while at + 2 < len(tokens):
            (k1, low), (k2, high), (k3, target) = tokens[at : at + 3]
            first, last = (_hex(low) if low else None, _hex(high) if high else None) if k1 == k2 == "<" else (None, None)
            if first is None or last is None:
                at += 1
                continue
            into = out.single if max(1, len(low) // 2) == 1 else out.double
            if k3 == "<":
                start = _hex(target) if target else None
                if start is not None:
                    into.set_range(first, last, start)
            else:
                for code, each in zip(range(first, last + 1), _LITERAL.findall(target)):
                    into.set(code, target_text(each))
            at += 3
    return out


@dataclass
class Font:
    width: int = 1
    cmap: CMap | None = None
    table: list[int] | None = None
    differences: dict[int, str] = field(default_factory=dict)

    def one(self, code: int, width: int) -> str:
        if self.cmap is not None:
            got = self.cmap.get(code, width)
            if got is not None:
                return got
        if code in self.differences:
            point = glyph_code(self.differences[code])
            return "" if point is None or not 0 <= point <= 0x10FFFF else chr(point)
        if self.table and code < 256 and self.table[code]:
            return chr(self.table[code])
        return chr(code) if self.cmap is None and 0x20 <= code <= 0xFF else ""

    def decode(self, data: bytes) -> str:
        """Codes of one or two bytes; an odd last byte is a code of its own."""
        if self.width == 1:
            return data.decode("latin-1").translate(self._single)
        n = len(data) // 2
        text = "".join(map(self._pairs.__getitem__, struct.unpack_from(f">{n}H", data)))
        return text + self.one(data[-1], 1) if len(data) % 2 else text

    @cached_property
    def _single(self) -> _Codes:
        return _Codes(self, 1)

    @cached_property
    def _pairs(self) -> _Codes:
        return _Codes(self, 2)


class _Codes(dict):
    """The texts of a font's codes of one or of two bytes, as far as they have been asked for."""

    def __init__(self, font: Font, width: int):
        super().__init__()
        self.font, self.width = font, width

    def __missing__(self, code: int) -> str:
        got = self[code] = self.font.one(code, self.width)
        return got


def differences(items) -> dict[int, str]:
    out, code = {}, -1
    for item in items if isinstance(items, list) else []:
        if type(item) is int:
            code = item
        elif isinstance(item, Name) and code >= 0:
            out[code] = str(item)
            code += 1
    return out


def load_font(document, dictionary: dict) -> Font:
    """A font from its dictionary. Only an indirect ToUnicode stream counts."""
    composite = name(dictionary.get("Subtype")) == "Type0"
    cmap, ref = None, dictionary.get("ToUnicode")
    if isinstance(ref, Ref):
        data = document.stream(ref)
        if data:
            try:
                cmap = parse_cmap(data)
            except ValueError:
                cmap = None
    font = Font(2 if composite or (cmap and cmap.width >= 2) else 1, cmap)
    if composite:
        return font
    encoding = dictionary.get("Encoding")
    resolved = document.deref(encoding)
    if isinstance(resolved, Name):
        font.table = ENCODINGS.get(resolved)
    elif isinstance(resolved, dict):
        base = resolved.get("BaseEncoding")
        font.table = ENCODINGS.get(base if isinstance(base, Name) else "", ENCODINGS["WinAnsiEncoding"])
        font.differences = differences(resolved.get("Differences"))
    else:
        font.table = ENCODINGS["WinAnsiEncoding"]
    return font


class Fonts:
    """The fonts of a page's resources by name, loaded when asked for."""

    def __init__(self, document, resources: dict | None):
        self.document = document
        found = document.deref((resources or {}).get("Font"))
        self.listed = found if isinstance(found, dict) else {}
        self.loaded: dict[str, Font | None] = {}

    def get(self, key: str) -> Font | None:
        if key not in self.loaded:
            listed = self.listed.get(key, NULL)
            if isinstance(listed, Ref) and listed in self.document.fonts:
                self.loaded[key] = self.document.fonts[listed]
            else:
                value = self.document.deref(listed)
                self.loaded[key] = load_font(self.document, value) if isinstance(value, dict) else None
                if isinstance(listed, Ref):  # pages share fonts
                    self.document.fonts[listed] = self.loaded[key]
        return self.loaded[key]

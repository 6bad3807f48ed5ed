"""PDF objects, and the lexer and parser that read them from bytes.

Names are Name, strings bytes, references Ref, null NULL; numbers, booleans, arrays and dictionaries are Python's.
"""

from __future__ import annotations

import math
import re
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple


class PdfError(ValueError):
    """Bytes that are not what the syntax asks for."""


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


class _Null:
    def __repr__(self) -> str:
        return "null"


NULL = _Null()
SPACE = b"\x00\t\n\x0c\r "
_REGULAR = rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]"
#: White space and comments, then a token: integer, real, word, name, plain string, mark, hexadecimal string.
TOKEN = re.compile(
    rb"(?:[\x00\t\n\x0c\r ]++|%[^\r\n]*+)*+(?:([+-]?[0-9]++)(?!REG)|([+-]?(?:[0-9]++\.[0-9]*+|\.[0-9]++))(?!REG)|(REG++)|/(REG*+)"
    rb"|\(([^()\\\r]*+)\)|(<<|>>|[\[\]{}])|<([0-9A-Fa-f\x00\t\n\x0c\r ]*+)>)?".replace(b"REG", _REGULAR)
)
#: As above, without comments: reference, name, integer, plain string, mark, real, word, hexadecimal string.
_USUAL = re.compile(
    rb"[\x00\t\n\x0c\r ]*+(?:([0-9]{1,9})[\x00\t\n\x0c\r ]++([0-9]{1,9})[\x00\t\n\x0c\r ]++R(?!REG)|/(REG*+)|([+-]?[0-9]{1,18}+)(?!REG)|\(([^()\\\r]*+)\)|(<<|>>|[\[\]])"
    rb"|([+-]?(?:[0-9]++\.[0-9]*+|\.[0-9]++))(?!REG)|(true|false|null)(?!REG)|<((?:[0-9A-Fa-f]{2})*+)>)".replace(b"REG", _REGULAR)
)
_OBJECT = re.compile(rb"[\x00\t\n\x0c\r ]*+([0-9]{1,9})[\x00\t\n\x0c\r ]++([0-9]{1,9})[\x00\t\n\x0c\r ]++obj(?!REG)".replace(b"REG", _REGULAR))
#: A dictionary without strings, comments and escapes, up to the end of its object or to its stream. Vertical tabs and
#: zeros are not what bytes.split() takes them for.
_PLAIN = re.compile(rb"[\t\n\x0c\r ]*+(<<[^()%{}#\x00\x0b]*?>>)[\t\n\x0c\r ]*+(?=endobj|stream)")
#: What follows the number of a reference; and a comment before or after the generation, which needs a closer look.
_REFERENCE = re.compile(rb"[\x00\t\n\x0c\r ]++\+?([0-9]{1,18})[\x00\t\n\x0c\r ]++R(?!REG)".replace(b"REG", _REGULAR))
_COMMENTED = re.compile(rb"[\x00\t\n\x0c\r ]*+(?:\+?[0-9]++[\x00\t\n\x0c\r ]*+)?+%")
_WHOLE = re.compile(rb"[+-]?[0-9]+\Z")
_HEX_ESCAPE = re.compile(rb"#([0-9A-Fa-f]{2})")
_STRING_PART = re.compile(rb"[^()\\\r]+")
_ESCAPES = {0x6E: b"\n", 0x72: b"\r", 0x74: b"\t", 0x62: b"\b", 0x66: b"\f"}
MAX_DEPTH = 200
MAX_INT = (1 << 31) - 1


def whole_number(raw: bytes, bits: int = 64) -> int:
    """Digits with a sign or none as a number of so many bits; PdfError for anything else."""
    digits = raw.lstrip(b"+-").lstrip(b"0")
    if len(digits) <= 20 and _WHOLE.match(raw):
        value = int(digits or b"0") * (-1 if raw[0] == 0x2D else 1)
        if -(1 << bits - 1) <= value < 1 << bits - 1:
            return value
    raise PdfError("a number out of range")


def _real(raw: bytes) -> float:
    value = float(raw)
    if math.isinf(value):
        raise PdfError("a number out of range")
    return value


class Token(NamedTuple):
    kind: str  # word, int, real, name, string, hex, or a delimiter itself
    value: object
    offset: int


class Lexer:
    """Tokens of data from a position on. Comments and white space are skipped; None at the end."""

    def __init__(self, data: bytes, position: int = 0):
        if position < 0:
            raise PdfError("position before the start")
        self.data, self.at = data, position

    def next(self) -> Token | None:
        m = TOKEN.match(self.data, self.at)
        found = m.lastindex
        if found is None:
            return self._other(m.end())
        raw, self.at = m[found], m.end()
        if found == 1:
            return Token("int", int(raw) if len(raw) < 19 else whole_number(raw), m.start(1))
        if found == 2:
            return Token("real", _real(raw), m.start(2))
        if found == 3:
            return Token("word", raw.decode("latin-1"), m.start(3))
        if found == 4:
            if b"#" in raw:
                raw = _HEX_ESCAPE.sub(lambda h: bytes([int(h[1], 16)]), raw)
            return Token("name", Name(raw.decode("latin-1")), m.start(4) - 1)
        if found == 5:
            return Token("string", raw, m.start(5) - 1)
        if found == 6:
            return Token(raw.decode("ascii"), None, m.start(6))
        digits = raw.translate(None, SPACE)
        return Token("hex", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii")), m.start(7) - 1)

    def _other(self, at: int) -> Token | None:
        """At the end, a string with nesting or escapes, or bad syntax."""
        if at >= len(self.data):
            self.at = at
            return None
        if self.data[at] == 0x28:
            return self._string(at)
        raise PdfError("bad hexadecimal string" if self.data[at] == 0x3C else f"stray {chr(self.data[at])}")

    def _string(self, start: int) -> Token:
        data, at, depth, out = self.data, start + 1, 1, []
        while True:
            m = _STRING_PART.match(data, at)
            if m:
                out.append(m[0])
                at = m.end()
            if at >= len(data):
                raise PdfError("open string")
            c = data[at]
            if c == 0x29:
                depth -= 1
                if not depth:
                    break
                out.append(b")")
            elif c == 0x28:
                depth += 1
                out.append(b"(")
            elif c == 0x0D:  # any end of line counts as a line feed
                out.append(b"\n")
                at += data.startswith(b"\r\n", at)
            else:
                at += 1
                c = data[at] if at < len(data) else 0
                if 0x30 <= c <= 0x37:
                    n = 1
                    while n < 3 and at + n < len(data) and 0x30 <= data[at + n] <= 0x37:
                        n += 1
                    out.append(bytes([int(data[at : at + n], 8) & 0xFF]))
                    at += n - 1
                elif c == 0x0D:
                    at += data.startswith(b"\r\n", at)
                elif c != 0x0A:
                    out.append(_ESCAPES.get(c) or bytes([c]))
            at += 1
        self.at = at + 1
        return Token("string", b"".join(out), start)


#: Nesting that usual objects do not go beyond.
USUAL_DEPTH = 50
_WORDS = {b"true": True, b"false": False, b"null": NULL}
_SHORT_NUMBER = re.compile(rb"[+-]?(?:([0-9]{1,18})|[0-9]{1,18}\.[0-9]{0,18}|\.[0-9]{1,18})")


class _Atoms(dict):
    """Names, words and numbers by their bytes, as far as they have been met; None of what is none of them."""

    def __missing__(self, raw: bytes):
        if raw[0] == 0x2F:
            value = Name(raw[1:].decode("latin-1"))
        elif m := _SHORT_NUMBER.fullmatch(raw):
            value = float(raw) if m[1] is None else int(raw)
        else:
            value = _WORDS.get(raw)
        if len(self) >= 4096:
            self.clear()
        if len(raw) <= 40:
            self[raw] = value
        return value


_ATOMS = _Atoms()


def _plain(data: bytes, at: int) -> tuple[object, int] | None:
    """As _usual, of a dictionary that can be split at white space and marks."""
    m = _PLAIN.match(data, at)
    if m is None:
        return None
    words = m[1].replace(b"<<", b" << ").replace(b">>", b" >> ").replace(b"/", b" /").replace(b"[", b" [ ").replace(b"]", b" ] ").split()
    above: list = []
    into: dict | list = {}
    key, k, end = None, 1, len(words)
    words += (b"", b"")
    while k < end:
        raw = words[k]
        k += 1
        if raw.isdigit() and len(raw) <= 9:
            value = int(raw)
            if words[k + 1] == b"R":
                gen = words[k]
                if not gen.isdigit() or len(gen) > 9:
                    return None
                value = Ref(value, int(gen))
                k += 2
        elif raw == b"<<" or raw == b"[":
            if (key is None and type(into) is dict) or len(above) > USUAL_DEPTH:
                return None
            above.append((into, key))
            into, key = {} if raw == b"<<" else [], None
            continue
        elif raw == b">>" or raw == b"]":
            if (raw == b">>") is not (type(into) is dict) or key is not None:
                return None
            value = into
            if not above:
                return (value, m.end(1)) if k == end else None
            into, key = above.pop()
        else:
            value = _ATOMS[raw]
            if value is None:
                return None
            if key is None and type(into) is dict:
                if type(value) is not Name:
                    return None
                key = str(value)
                continue
        if type(into) is list:
            into.append(value)
        elif key is None:
            return None
        else:
            into[key], key = value, None
    return None


def _usual(data: bytes, at: int) -> tuple[object, int] | None:
    """A dictionary or an array of usual syntax, and where it ends; None of anything else, which parse_object reads
    token by token."""
    if got := _plain(data, at):
        return got
    match, above = _USUAL.match, []
    m = match(data, at)
    if m is None or m.lastindex != 6 or m[6] == b">>" or m[6] == b"]":
        return None
    into: dict | list = {} if m[6] == b"<<" else []
    of_dict, key, at = m[6] == b"<<", None, m.end()
    while True:
        m = match(data, at)
        if m is None:
            return None
        kind, at = m.lastindex, m.end()
        if kind == 3:
            raw = m[3]
            if b"#" in raw:
                return None
            value = raw.decode("latin-1")
            if of_dict and key is None:
                key = value
                continue
            value = Name(value)
        elif kind == 6:
            mark = m[6]
            if mark == b"<<" or mark == b"[":
                if (of_dict and key is None) or len(above) > USUAL_DEPTH:
                    return None
                above.append((into, key))
                of_dict = mark == b"<<"
                into, key = {} if of_dict else [], None
                continue
            if (mark == b">>") is not of_dict or key is not None:
                return None
            value = into
            if not above:
                return value, at
            into, key = above.pop()
            of_dict = type(into) is dict
        elif kind == 2:
            value = Ref(int(m[1]), int(m[2]))
        elif kind == 4:
            value = int(m[4])
        elif kind == 5:
            value = m[5]
        elif kind == 7:
            value = _real(m[7])
        elif kind == 8:
            value = _WORDS[m[8]]
        else:
            value = bytes.fromhex(m[9].decode("ascii"))
        if not of_dict:
            into.append(value)
        elif key is None:
            return None
        else:
            into[key], key = value, None


def parse_object(lexer: Lexer, token: Token | None = None, depth: int = 0):
    """The next object, with references recognised. Raises PdfError at anything else."""
    if token is None and not depth and (got := _usual(lexer.data, lexer.at)):
        lexer.at = got[1]
        return got[0]
    token = token or lexer.next()
    if token is None:
        raise PdfError("no object before the end")
    if depth > MAX_DEPTH:
        raise PdfError("objects nested too deep")
    kind, value = token.kind, token.value
    if kind == "int":
        back = lexer.at
        if value >= 0 and (m := _REFERENCE.match(lexer.data, back)):
            lexer.at, gen = m.end(), int(m[1])
            return Ref(value if value <= MAX_INT else 0, gen if gen <= MAX_INT else 0)
        if value >= 0 and _COMMENTED.match(lexer.data, back):
            try:
                gen = lexer.next()
                if gen and gen.kind == "int" and gen.value >= 0:
                    word = lexer.next()
                    if word and word.kind == "word" and word.value == "R":
                        return Ref(value if value <= MAX_INT else 0, gen.value if gen.value <= MAX_INT else 0)
            except PdfError:
                pass
        lexer.at = back
        return value
    if kind in ("real", "name", "string", "hex"):
        return value
    if kind == "[":
        items = []
        while True:
            token = lexer.next()
            if token is None:
                raise PdfError("open array")
            if token.kind == "]":
                return items
            items.append(parse_object(lexer, token, depth + 1))
    if kind == "<<":
        out: dict[str, object] = {}
        while True:
            token = lexer.next()
            if token is None:
                raise PdfError("open dictionary")
            if token.kind == ">>":
                return out
            if token.kind != "name":
                raise PdfError("a dictionary key that is not a name")
            out[str(token.value)] = parse_object(lexer, None, depth + 1)
    if kind == "word":
        if value in ("true", "false"):
            return value == "true"
        if value == "null":
            return NULL
    raise PdfError(f"no object at {token.offset}")


def object_id(data: bytes, position: int) -> tuple[Ref, int] | None:
    """"n g obj" of usual syntax, and where it ends."""
    m = _OBJECT.match(data, position) if position >= 0 else None
    return (Ref(int(m[1]), int(m[2])), m.end()) if m else None


def parse_bytes(data: bytes, position: int = 0):
    return parse_object(Lexer(data, position))


def integer(value) -> int | None:
    return value if type(value) is int else None


def number(value) -> float | None:
    return value if type(value) in (int, float) else None


def name(value) -> str | None:
    return str(value) if isinstance(value, Name) else None


def text_string(value) -> str | None:
    """A string object as text: UTF-16 by its byte order mark, else Latin-1."""
    if not isinstance(value, bytes):
        return None
    if value.startswith(b"\xfe\xff"):
        return value[2:].decode("utf-16-be", "replace")
    if value.startswith(b"\xff\xfe"):
        return value[2:].decode("utf-16-le", "replace")
    return value.decode("latin-1")


#: What counts as blank at the ends of texts and titles.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \xa0                　"


def format_number(value: float) -> str:
    """Four decimals at most, ties away from zero, without trailing zeros; next to nothing is 0."""
    if not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if abs(value) < 0.0001:
        return "0"
    if value == int(value) and abs(value) < 1 << 63:
        return str(int(value))
    shortest = Decimal(repr(float(value)))
    if shortest.as_tuple().exponent < -4:
        shortest = shortest.quantize(Decimal("0.0001"), ROUND_HALF_UP)
    text = f"{shortest:f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def escape_literal(text: str) -> str:
    return text.translate({0x5C: "\\\\", 0x28: "\\(", 0x29: "\\)", 0x0A: "\\n", 0x0D: "\\r", 0x09: "\\t"})


def escape_name(text: str) -> str:
    return "".join(c if 33 <= ord(c) <= 126 and c not in "#/%()<>[]{}" else f"#{ord(c):02X}" for c in text)


def serialize(value) -> str:
    """The text form of an object; strings in hexadecimal."""
    if value is NULL:
        return "null"
    if value is True or value is False:
        return "true" if value else "false"
    if isinstance(value, Ref):
        return f"{value.num} {value.gen} R"
    if isinstance(value, Name):
        return "/" + escape_name(value)
    if isinstance(value, bytes):
        return "<" + value.hex().upper() + ">"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return format_number(value)
    if isinstance(value, list):
        return "[" + " ".join(map(serialize, value)) + "]"
    if isinstance(value, dict):
        return "<<" + " ".join(f"/{escape_name(k)} {serialize(v)}" for k, v in value.items()) + ">>"
    raise TypeError(type(value))

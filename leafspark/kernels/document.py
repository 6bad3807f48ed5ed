"""A document's structure: header, cross-references and their revisions, objects, streams and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from leafspark.kernels import filters
from leafspark.kernels.objects import MAX_INT, SPACE, Lexer, Name, PdfError, Ref, integer, name, object_id, parse_object, whole_number

TAIL = 1 << 20
MAX_STREAM = 64 << 20
MAX_ENTRIES = MAX_OBJECTS = 100_000
_MARK = re.compile(rb"startxref[\x00\t\n\x0c\r ]+([0-9]+)")
_LINE = re.compile(rb"[^\r\n]*")
_LINE_END = re.compile(rb"\r\n|\r|\n")
_ENTRIES = re.compile(rb"(?:0[0-9]{9} [0-9]{5} [nf](?: \r| \n|\r\n))*+\Z")


class Entry(NamedTuple):
    """Where an object is: kind "in_use" (at an offset), "free" (the next free number) or "compressed" (a stream and the
    index in it). rank 0 is the newest section that was read; a hybrid file's stream stands between two ranks."""

    kind: str
    a: int
    b: int = 0
    rank: float = 0.0


@dataclass
class Section:
    entries: dict[tuple[int, int], Entry] = field(default_factory=dict)
    packed: dict[tuple[int, int], Entry] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)

    def over(self, older: Section) -> Section:
        """This section above an older one: a number known here hides all older entries of that number."""
        known = {num for num, _ in self.entries} | {num for num, _ in self.packed}
        keep = lambda m: {k: v for k, v in m.items() if k[0] not in known}
        return Section(keep(older.entries) | self.entries, keep(older.packed) | self.packed, older.trailer | self.trailer)


@dataclass(frozen=True)
class Page:
    ref: Ref | None
    dictionary: dict
    resources: dict | None


def _int32(value: int) -> int:
    """The low 32 bits, with sign: what numbers of objects and generations are kept in."""
    return (value + (1 << 31) & (1 << 32) - 1) - (1 << 31)


class _Reader:
    """Reads the chain of cross-reference sections from an offset."""

    def __init__(self, data: bytes):
        self.data = data
        self.seen: set[int] = set()
        self.rank = -1.0

    def section(self, offset: int) -> Section | None:
        if offset in self.seen:
            return None
        self.seen.add(offset)
        if not 0 <= offset < len(self.data):
            raise PdfError("cross-references beyond the file")
        self.rank = float(int(self.rank) + 1)
        return self._table(offset) if self.data[offset] == 0x78 else self._stream(offset, self.rank)

    def _older(self, current: Section, trailer: dict) -> Section:
        prev = integer(trailer.get("Prev"))
        older = None if prev is None else self.section(prev)
        return current if older is None else current.over(older)

    def _lines(self, at: int):
        n = len(self.data)
        while at < n:
            m = _LINE.match(self.data, at)
            if m[0].strip(SPACE + b"\x0b"):
                yield m.start(), m[0]
            at = m.end() + 1

    def _usual(self, at: int, first: int, count: int, entries: dict, rank: float) -> int | None:
        """Reads entries of 20 bytes each, as they usually are, and returns where they end; None if any is otherwise."""
        m = _LINE_END.match(self.data, at)
        if not m or not 0 < count <= len(self.data) // 20:
            return None
        block = self.data[m.end() : m.end() + 20 * count]
        if len(block) < 20 * count or not _ENTRIES.match(block):
            return None
        lines: dict[bytes, tuple[int, Entry]] = {}  # many are alike: free numbers between others
        for k, line in enumerate(map(block.__getitem__, map(slice, range(0, 20 * count, 20), range(20, 20 * count + 20, 20))), first):
            got = lines.get(line)
            if got is None:
                got = lines[line] = int(line[11:16]), Entry("in_use" if line[17] == 0x6E else "free", int(line[:10]), 0, rank)
            entries[k, got[0]] = got[1]
        return m.end() + len(block)

    def _table(self, offset: int) -> Section:
        rank, lines, entries = self.rank, self._lines(offset), {}
        try:
            if next(lines)[1].strip() != b"xref":
                raise PdfError("no xref keyword")
            while True:
                at, line = next(lines)
                words = line.split()
                if words[0].startswith(b"trailer") and (len(words[0]) == 7 or words[0][7:8] in b"()<>[]{}/%\x00"):
                    after = at + line.index(b"trailer") + 7
                    break
                if len(words) != 2:
                    raise PdfError("no subsection header")
                first, count = whole_number(words[0], 32), whole_number(words[1], 32)
                at = self._usual(at + len(line), first, count, entries, rank)
                if at is not None:
                    lines = self._lines(at)
                    continue
                for k in range(count):
                    a, gen, flag = next(lines)[1].split()[:3]
                    if flag not in (b"n", b"f"):
                        raise PdfError("no entry flag")
                    offset_or_next = whole_number(a)
                    entries[first + k, whole_number(gen, 32)] = Entry("in_use", offset_or_next, 0, rank) if flag == b"n" else Entry("free", _int32(offset_or_next), 0, rank)
        except (StopIteration, ValueError) as e:
            raise e if isinstance(e, PdfError) else PdfError("bad cross-reference table") from None
        start = self.data.find(b"<<", after)
        if start < 0:
            raise PdfError("no trailer dictionary")
        trailer = parse_object(Lexer(self.data, start))
        current = Section(entries, {}, trailer)
        more = integer(trailer.get("XRefStm"))
        if more is not None and more not in self.seen:
            self.seen.add(more)
            hybrid = self._stream(more, rank + 0.5, follow=False)
            if hybrid is not None:
                current = current.over(hybrid)
        return self._older(current, trailer)

    def _stream(self, offset: int, rank: float, follow: bool = True) -> Section | None:
        header = stream_header(self.data, offset)
        if header is None:
            return None
        ref, trailer, start = header
        size, widths = integer(trailer.get("Size")), trailer.get("W")
        if name(trailer.get("Type")) != "XRef" or size is None or not isinstance(widths, list) or len(widths) < 3:
            return None
        widths = [integer(w) for w in widths[:3]]
        if any(w is None or not 0 <= w <= 8 for w in widths) or not sum(widths):
            return None
        index = trailer.get("Index")
        if not isinstance(index, list) or len(index) % 2 or any(integer(x) is None for x in index):
            index = [0, size]
        pairs = list(zip(index[::2], index[1::2]))
        if any(a < 0 or n < 0 or a + n > MAX_INT + 1 for a, n in pairs):
            return None
        total = sum(n for _, n in pairs)
        if total > MAX_ENTRIES or total * sum(widths) > MAX_STREAM:
            return None
        length = integer(trailer.get("Length"))
        if length is None or max(0, length) > min(MAX_STREAM, len(self.data) - start):
            return None
        raw = self.data[start : start + max(0, length)]
        table = filters.decode(raw, trailer, strict=True, limit=total * sum(widths))
        if table is None or len(table) != total * sum(widths):
            return None
        out, at = Section(trailer=trailer), 0
        for first, count in pairs:
            for num in range(first, first + count):
                fields = []
                for w in widths:
                    fields.append(int.from_bytes(table[at : at + w], "big", signed=w == 8))
                    at += w
                kind = fields[0] if widths[0] else 1
                if kind == 0:
                    out.entries[num, _int32(fields[2])] = Entry("free", _int32(fields[1]), 0, rank)
                elif kind == 1:
                    out.entries[num, _int32(fields[2])] = Entry("in_use", fields[1], 0, rank)
                elif kind == 2:
                    out.packed[num, 0] = Entry("compressed", _int32(fields[1]), _int32(fields[2]), rank)
        out.entries[ref] = Entry("in_use", offset, 0, rank)
        return self._older(out, trailer) if follow else out


def object_at(data: bytes, offset: int) -> tuple[Ref, object, Lexer] | None:
    """"n g obj" and the object after it; the lexer stands behind it."""
    usual = object_id(data, offset)
    if usual:
        lexer = Lexer(data, usual[1])
        return usual[0], parse_object(lexer), lexer
    lexer = Lexer(data, offset)
    num, gen, word = lexer.next(), lexer.next(), lexer.next()
    if not (num and gen and word) or (num.kind, gen.kind, word.value) != ("int", "int", "obj"):
        return None
    return Ref(num.value, gen.value), parse_object(lexer), lexer


def stream_header(data: bytes, offset: int) -> tuple[Ref, dict, int] | None:
    """Id, dictionary and payload start of a stream object. The keyword must be followed by an end of line."""
    got = object_at(data, offset)
    if got is None or not isinstance(got[1], dict):
        return None
    at = got[2].at + 1
    if data.startswith((b"\nstream\n", b"\nstream\r\n"), at - 1):
        at += 6
    else:
        word = got[2].next()
        if word is None or word.value != "stream":
            raise PdfError("no stream keyword")
        at = word.offset + 6
    if data.startswith(b"\r\n", at):
        return got[0], got[1], at + 2
    if data[at : at + 1] in (b"\n", b"\r"):
        return got[0], got[1], at + 1
    raise PdfError("no end of line after the stream keyword")


class Document:
    def __init__(self, data: bytes, section: Section, start: int):
        self.data, self.entries, self.packed, self.trailer, self.start = data, section.entries, section.packed, section.trailer, start
        self._objects: dict[Ref, object] = {}
        self._streams: dict[int, list[tuple[int, object]]] = {}
        self.fonts: dict[Ref, object] = {}  # by reference, once loaded

    # -- lookup

    def resolve(self, ref: Ref):
        """The object of a reference; None where there is none or its id is another."""
        if ref in self._objects:
            return self._objects[ref]
        self._objects[ref] = None  # an object that needs itself has no value
        entry = self.entries.get(tuple(ref))
        value = None
        if entry and entry.kind == "in_use":
            try:
                got = object_at(self.data, entry.a)
                value = got[1] if got and got[0] == ref else None
            except PdfError:
                value = None
        else:
            packed = self.packed.get(tuple(ref))
            if packed:
                value = self._unpacked(packed.a, packed.b, ref.num)
        self._objects[ref] = value
        return value

    def deref(self, value):
        return self.resolve(value) if isinstance(value, Ref) else value

    def _unpacked(self, stream: int, index: int, num: int):
        if stream not in self._streams:
            self._streams[stream] = []  # also while it is being read
            self._streams[stream] = self.object_stream(stream) or []
        found = self._streams[stream]
        return found[index][1] if 0 <= index < len(found) and found[index][0] == num else None

    def object_stream(self, num: int, limit: int = MAX_STREAM) -> list[tuple[int, object]] | None:
        """(number, object) of an object stream in order; None if anything in it is bad."""
        try:
            entry = self.entries.get((num, 0))
            header = stream_header(self.data, entry.a) if entry and entry.kind == "in_use" else None
            if header is None or header[0] != Ref(num, 0) or name(header[1].get("Type")) != "ObjStm":
                return None
            count, first = integer(header[1].get("N")), integer(header[1].get("First"))
            if count is None or not 0 <= count <= MAX_OBJECTS or first is None:
                return None
            body = self.stream(Ref(num, 0), limit, limit)
            if body is None:
                return None
            lexer, pairs = Lexer(body), []
            for _ in range(count):
                pair = integer(parse_object(lexer)), integer(parse_object(lexer))
                if None in pair:
                    return None
                pairs.append(pair)
            return [(n, parse_object(Lexer(body, max(0, first) + at))) for n, at in pairs]
        except PdfError:
            return None

    def next_number(self, count: int) -> int | None:
        """The first of count unused object numbers; None if there are not so many."""
        size = integer(self.trailer.get("Size")) or 0
        first = max(1, size, max((n for n, _ in self.entries), default=-1) + 1, max((n for n, _ in self.packed), default=-1) + 1)
        return first if count > 0 and first + count <= MAX_INT else None

    # -- streams

    def stream(self, ref: Ref, max_raw: int | None = None, limit: int | None = None) -> bytes | None:
        """The decoded data of a stream object; empty for a length of 0, None if it cannot be had in full."""
        entry = self.entries.get(tuple(ref))
        if not entry or entry.kind != "in_use":
            return None
        header = stream_header(self.data, entry.a)
        if header is None or header[0] != ref:
            return None
        length = integer(self.deref(header[1].get("Length")))
        if length is None:
            return None
        if length <= 0:
            return b""
        if length > len(self.data) - header[2] or (max_raw is not None and length > max_raw):
            return None
        return filters.decode(self.data[header[2] : header[2] + length], header[1], self.resolve, limit=limit)

    def contents(self, page: Page) -> bytes | None:
        """The content streams of a page, joined by line feeds; None if one fails."""
        value = page.dictionary.get("Contents")
        if value is None:
            return b""
        refs = [value] if isinstance(value, Ref) else [r for r in value if isinstance(r, Ref)] if isinstance(value, list) else None
        if refs is None:
            return None
        parts = [self.stream(r) for r in refs]
        return None if None in parts else b"\n".join(parts)

    # -- pages

    def pages(self) -> list[Page]:
        """Leaves of the page tree in order. A node counts once, wherever it is met first; resources are those of the
        nearest node that has a dictionary of them."""
        root = self.deref(self.trailer.get("Root"))
        out: list[Page] = []
        if not isinstance(root, dict):
            return out
        seen: set[Ref] = set()
        stack: list[tuple[object, dict | None]] = [(root.get("Pages"), None)]
        while stack:
            value, above = stack.pop()
            ref = value if isinstance(value, Ref) else None
            if ref is not None:
                if ref in seen:
                    continue
                seen.add(ref)
            node = self.deref(value)
            if not isinstance(node, dict):
                continue
            own = self.deref(node.get("Resources"))
            resources = own if isinstance(own, dict) else above
            if name(node.get("Type")) == "Page":
                out.append(Page(ref, node, resources))
                continue
            kids = self.deref(node.get("Kids"))
            if isinstance(kids, list):
                stack += [(kid, resources) for kid in reversed(kids)]
        return out


def start_of(data: bytes) -> tuple[int, Section | None]:
    """The greatest offset in a startxref marker of the file's tail at which cross-references can be read."""
    marks = (m[1].lstrip(b"0") for m in _MARK.finditer(data, max(0, len(data) - TAIL)))
    offsets = {int(digits or b"0") for digits in marks if len(digits) <= 19}
    for offset in sorted((o for o in offsets if o < len(data)), reverse=True):
        try:
            section = _Reader(data).section(offset)
        except (PdfError, RecursionError):
            continue
        if section is not None:
            return offset, section
    raise PdfError("no cross-references")


def open_document(data: bytes) -> Document:
    """Raises PdfError for what is not a PDF, is encrypted or has no readable cross-references."""
    if b"%PDF-" not in data[:1024]:
        raise PdfError("no PDF header")
    start, section = start_of(data)
    if "Encrypt" in section.trailer:
        raise PdfError("encrypted")
    return Document(data, section, start)


def type_of(value: dict, key: str) -> str | None:
    return str(value[key]) if isinstance(value.get(key), Name) else None

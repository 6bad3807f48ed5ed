"""Writes small PDFs: the fixtures of tests and of the registered queries, whose tables hold no PDFs."""

from __future__ import annotations

import zlib

import numpy as np


def stream(data: bytes, more: str = "") -> bytes:
    return f"<< /Length {len(data)}{more} >>\nstream\n".encode() + data + b"\nendstream"


def flate_stream(data: bytes) -> bytes:
    return stream(zlib.compress(data), " /Filter /FlateDecode")


def classic(objects: dict[int, bytes], trailer: str = "/Root 1 0 R", version: str = "1.4") -> bytes:
    """A file with a cross-reference table; numbers between objects are free."""
    out, offsets = bytearray(f"%PDF-{version}\n%\xe2\xe3\xcf\xd3\n".encode("latin-1")), {}
    for num, body in objects.items():
        offsets[num] = len(out)
        out += f"{num} 0 obj\n".encode() + body + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    table = "0000000000 65535 f \n" + "".join(f"{offsets[n]:010d} 00000 n \n" if n in offsets else "0000000000 00000 f \n" for n in range(1, size))
    out += f"xref\n0 {size}\n{table}trailer\n<< /Size {size} {trailer} >>\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def compressed(objects: dict[int, bytes], packed: dict[int, bytes], root: int = 1, flate: bool = True, predictor: bool = False) -> bytes:
    """A file with an object stream of `packed` and a cross-reference stream."""
    out, offsets = bytearray(b"%PDF-1.5\n"), {}
    last = max([*objects, *packed])
    container, table = last + 1, last + 2
    heads, bodies = [], bytearray()
    for num, body in packed.items():
        heads.append(f"{num} {len(bodies)}")
        bodies += body + b"\n"
    head = " ".join(heads).encode() + b"\n"
    data, more = head + bytes(bodies), f" /Type /ObjStm /N {len(packed)} /First {len(head)}"
    for num, body in {**objects, container: stream(zlib.compress(data), more + " /Filter /FlateDecode") if flate else stream(data, more)}.items():
        offsets[num] = len(out)
        out += f"{num} 0 obj\n".encode() + body + b"\nendobj\n"
    offsets[table] = len(out)
    index = {n: (2, container, k) for k, n in enumerate(packed)} | {n: (1, at, 0) for n, at in offsets.items()}
    rows = b"".join(bytes([k]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for k, a, b in (index.get(n, (0, 0, 0)) for n in range(table + 1)))
    more = f" /Type /XRef /Size {table + 1} /W [1 4 2] /Root {root} 0 R"
    if predictor:
        rows = png_up(rows, 7)
        more += " /DecodeParms << /Predictor 12 /Columns 7 >>"
    body = stream(zlib.compress(rows), more + " /Filter /FlateDecode") if flate else stream(rows, more)
    out += f"{table} 0 obj\n".encode() + body + f"\nendobj\nstartxref\n{offsets[table]}\n%%EOF\n".encode()
    return bytes(out)


def hybrid(objects: dict[int, bytes], hidden: dict[int, bytes], trailer: str = "/Root 1 0 R") -> bytes:
    """A file with a cross-reference table whose trailer names a stream of the objects that the table has not."""
    out, offsets = bytearray(b"%PDF-1.5\n"), {}
    for num, body in {**objects, **hidden}.items():
        offsets[num] = len(out)
        out += f"{num} 0 obj\n".encode() + body + b"\nendobj\n"
    size, more = max([*objects, *hidden]) + 2, len(out)
    rows = b"".join(b"\x01" + offsets[n].to_bytes(4, "big") + b"\0\0" for n in sorted(hidden))
    index = " ".join(f"{n} 1" for n in sorted(hidden))
    out += f"{size - 1} 0 obj\n".encode() + stream(rows, f" /Type /XRef /Size {size} /W [1 4 2] /Index [{index}]") + b"\nendobj\n"
    start = len(out)
    table = "".join(f"{n} 1\n{offsets[n]:010d} 00000 n \n" for n in sorted(objects))
    return bytes(out) + f"xref\n{table}trailer\n<< /Size {size} {trailer} /XRefStm {more} >>\nstartxref\n{start}\n%%EOF\n".encode()


def many_entries(count: int) -> bytes:
    """A file whose cross-reference stream has so many entries, all but two of them free."""
    out = bytearray(b"%PDF-1.5\n")
    root = len(out)
    out += b"1 0 obj\n<< /Type /Catalog >>\nendobj\n"
    start = len(out)
    entry = lambda kind, at: bytes([kind]) + at.to_bytes(4, "big") + b"\0\0"
    rows = entry(0, 0) + entry(1, root) + entry(1, start) + entry(0, 0) * (count - 3)
    out += b"2 0 obj\n" + stream(zlib.compress(rows), f" /Type /XRef /Size {count} /W [1 4 2] /Root 1 0 R /Filter /FlateDecode") + f"\nendobj\nstartxref\n{start}\n%%EOF\n".encode()
    return bytes(out)


def png_up(data: bytes, row: int) -> bytes:
    """Rows tagged and filtered against the row above."""
    rows = np.frombuffer(data.ljust(-(-len(data) // row) * row, b"\0"), np.uint8).reshape(-1, row)
    out = np.full((len(rows), row + 1), 2, np.uint8)
    out[:, 1:] = rows
    out[1:, 1:] -= rows[:-1]
    return out.tobytes()


def _escaped(raw: bytes) -> bytes:
    """What stands in a literal string, but for line feeds."""
    for plain, escaped in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\r", b"\\r"), (b"\t", b"\\t")):
        raw = raw.replace(plain, escaped)
    return raw


def lines_content(text: str, encode=None) -> bytes:
    """A text object that shows each line of text a step below the last; encode gives the codes of a line, else they are
    Latin-1."""
    if encode is None:
        lines = _escaped(text.encode("latin-1", "replace"))
    else:
        lines = b"\n".join(_escaped(encode(line)).replace(b"\n", b"\\n") for line in text.split("\n"))
    return b"BT /F1 12 Tf 72 720 Td\n(" + lines.replace(b"\n", b") Tj 0 -14 Td\n(") + b") Tj 0 -14 Td\nET"


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def text_pdf(contents: list[bytes], fonts: dict[int, bytes] | None = None, extra: dict[int, bytes] | None = None, catalog: str = "", fanout: int = 0) -> bytes:
    """One page for each content stream, in a flat tree or in nodes of `fanout` pages each. Objects: 1 catalog, 2 pages,
    3 font, then pages and contents from 100 on in turn; fonts adds or replaces objects, as does extra."""
    objects = {3: FONT}
    pages = [100 + 2 * k for k in range(len(contents))]
    for num, data in zip(pages, contents):
        objects[num + 1] = flate_stream(data)
    groups = [pages[k : k + fanout] for k in range(0, len(pages), fanout)] if fanout else [pages]
    resources = "/Resources << /Font << /F1 3 0 R >> >>"
    kids = lambda refs: "[" + " ".join(f"{r} 0 R" for r in refs) + "]"
    if fanout:
        nodes = [100 + 2 * len(contents) + k for k in range(len(groups))]
        objects[2] = f"<< /Type /Pages /Kids {kids(nodes)} /Count {len(pages)} {resources} >>".encode()
        for node, group in zip(nodes, groups):
            objects[node] = f"<< /Type /Pages /Parent 2 0 R /Kids {kids(group)} /Count {len(group)} >>".encode()
    else:
        objects[2] = f"<< /Type /Pages /Kids {kids(pages)} /Count {len(pages)} {resources} >>".encode()
    for num in pages:
        objects[num] = f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents {num + 1} 0 R >>".encode()
    objects[1] = f"<< /Type /Catalog /Pages 2 0 R{catalog} >>".encode()
    return classic(dict(sorted({**objects, **(fonts or {}), **(extra or {})}.items())))


def unicode_fonts(text: str) -> tuple[dict[int, bytes], dict[str, int]]:
    """A two-byte font with a ToUnicode map for the characters of text, and their codes."""
    codes = {c: k + 1 for k, c in enumerate(sorted(set(text) - {"\n"}))}
    pairs = [f"<{k:04X}> <{c.encode('utf-16-be').hex().upper()}>" for c, k in codes.items()]
    body = ["begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange"]
    body += [f"{len(pairs[k : k + 100])} beginbfchar\n" + "\n".join(pairs[k : k + 100]) + "\nendbfchar" for k in range(0, len(pairs), 100)]
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /Any /Encoding /Identity-H /ToUnicode 4 0 R >>"
    return {3: font, 4: flate_stream("\n".join([*body, "endcmap"]).encode())}, codes


def unicode_pdf(text: str) -> bytes:
    fonts, codes = unicode_fonts(text)
    return text_pdf([lines_content(text, lambda line: b"".join(codes[c].to_bytes(2, "big") for c in line))], fonts)


def kerned_content(words: list[str], kern: int = -250) -> bytes:
    """One line whose words stand apart by kerning alone."""
    shown = f" {kern} ".join(f"({_escaped(w.encode("latin-1", "replace")).replace(b"\n", b"\\n").decode("latin-1")})" for w in words)
    return f"BT /F1 12 Tf 72 720 Td [{shown}] TJ ET".encode("latin-1", "replace")

"""Annotations appended to a document as an incremental update. Numbers are 32-bit floats throughout."""

from __future__ import annotations

import numpy as np

from leafspark.kernels.document import open_document
from leafspark.kernels.objects import BLANK, PdfError, Ref, escape_literal, format_number, number, serialize

F32 = np.float32
NOTE, PAGE_HEIGHT = F32(22), F32(792)


def numbers(values) -> str:
    return "[" + " ".join(format_number(float(F32(v))) for v in values) + "]"


def _upright(rect) -> tuple:
    l, t, r, b = (F32(rect[k]) for k in ("left", "top", "right", "bottom"))
    return min(l, r), min(t, b), max(l, r), max(t, b)


def _flipped(rect, height) -> tuple:
    l, t, r, b = rect
    return l, height - b, r, height - t


def _color(note: dict) -> str:
    return numbers(min(F32(1), max(F32(0), F32(note.get(k) or 0))) for k in ("red", "green", "blue"))


def highlight(note: dict, height) -> str | None:
    """The object of a highlight: None if no rectangle has an area."""
    rects = [r for r in map(_upright, note.get("rects") or []) if r[2] > r[0] and r[3] > r[1]]
    if not rects:
        return None
    box = tuple(f(r[k] for r in rects) for k, f in enumerate((min, min, max, max)))
    quads = [v for l, t, r, b in rects for v in (l, height - t, r, height - t, l, height - b, r, height - b)]
    said = (note.get("contents") or "").strip(BLANK)
    end = f" /Contents ({escape_literal(said)})" if said else ""
    return f"<< /Type /Annot /Subtype /Highlight /Rect {numbers(_flipped(box, height))} /QuadPoints {numbers(quads)} /C {_color(note)} /F 4{end} >>"


def sticky(note: dict, height) -> str:
    x, y = F32(note.get("x") or 0), F32(note.get("y") or 0)
    box = _flipped((x, y, x + NOTE, y + NOTE), height)
    said = escape_literal((note.get("contents") or "").strip(BLANK))
    return f"<< /Type /Annot /Subtype /Text /Rect {numbers(box)} /C {_color(note)} /Name /Comment /Open false /F 4 /Contents ({said}) >>"


def page_height(page) -> np.float32:
    """Of the page's own media box; a usual one where that makes no sense."""
    box = page.dictionary.get("MediaBox")
    at = lambda k: number(box[k]) if isinstance(box, list) and len(box) > k else None
    low, high = at(1), at(3)
    height = (PAGE_HEIGHT if high is None else F32(high)) - (F32(0) if low is None else F32(low))
    return height if height > 0 else PAGE_HEIGHT


def append(data: bytes, notes: list[dict]) -> bytes:
    """data with notes (kind "highlight" or "note") appended; data itself where nothing can be."""
    if not notes:
        return data
    try:
        document = open_document(data)
    except (PdfError, RecursionError):
        return data
    pages, by_page = document.pages(), {}
    for note in notes:
        if 0 <= note["page_index"] < len(pages):
            by_page.setdefault(note["page_index"], []).append(note)
    free = document.next_number(sum(map(len, by_page.values()))) if by_page else None
    if free is None:
        return data
    bodies: dict[Ref, str] = {}
    for index, own in by_page.items():
        page = pages[index]
        if page.ref is None:
            continue
        height, added = page_height(page), []
        for note in own:
            body = highlight(note, height) if note["kind"] == "highlight" else sticky(note, height)
            if body is not None:
                added.append(Ref(free, 0))
                bodies[added[-1]] = body
                free += 1
        if added:
            had = document.deref(page.dictionary.get("Annots"))
            bodies[page.ref] = serialize({**page.dictionary, "Annots": [*(had if isinstance(had, list) else []), *added]})
    return _update(data, document, bodies, free) if bodies else data


def sections(refs: list[Ref]) -> list[list[Ref]]:
    """Sorted references as runs of neighbouring numbers of one generation."""
    out: list[list[Ref]] = []
    for ref in sorted(refs):
        if out and out[-1][-1].gen == ref.gen and out[-1][-1].num + 1 == ref.num:
            out[-1].append(ref)
        else:
            out.append([ref])
    return out


def _update(data: bytes, document, bodies: dict[Ref, str], size: int) -> bytes:
    parts, at, offsets = [data], len(data), {}

    def put(text: str) -> None:
        nonlocal at
        parts.append(text.encode("latin-1", "replace"))
        at += len(parts[-1])

    if data[-1:] not in (b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b" ", b"\x1c", b"\x1d", b"\x1e", b"\x1f"):
        put("\n")
    for ref in sorted(bodies):
        offsets[ref] = at
        put(f"{ref.num} {ref.gen} obj\n{bodies[ref]}\nendobj\n")
    start = at
    put("xref\n")
    for run in sections(list(bodies)):
        put(f"{run[0].num} {len(run)}\n" + "".join(f"{offsets[r]:010d} {r.gen:05d} n \n" for r in run))
    root = f" /Root {serialize(document.trailer['Root'])}" if "Root" in document.trailer else ""
    put(f"trailer\n<< /Size {size}{root} /Prev {document.start} >>\nstartxref\n{start}\n%%EOF\n")
    return b"".join(parts)

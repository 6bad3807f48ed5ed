"""Private data blocks that Illustrator keeps in a page's piece information."""

from __future__ import annotations

import re

from leafspark.kernels.objects import MAX_INT, PdfError, Ref

_KEY = re.compile(r"AIPrivateData([0-9]+)\Z")


def page_blocks(document, page) -> list[tuple[int, bytes]]:
    """(number, bytes) by number. Keys with leading zeros or of more than 32 bits, and blocks that cannot be read, are left
    out."""
    node = page.dictionary
    for key in ("PieceInfo", "Illustrator", "Private"):
        node = document.deref(node.get(key))
        if not isinstance(node, dict):
            return []
    numbers = {int(m[1]) for m in map(_KEY.match, node) if m and len(m[1].lstrip("0")) <= 10}
    found = [(n, _read(document, node.get(f"AIPrivateData{n}"))) for n in sorted(numbers) if n <= MAX_INT]
    return [(n, b) for n, b in found if b is not None]


def _read(document, value) -> bytes | None:
    if isinstance(value, bytes):
        return value
    if not isinstance(value, Ref):
        return None
    got = document.resolve(value)
    if isinstance(got, bytes):
        return got
    try:
        return document.stream(value)
    except PdfError:
        return None


def first_blocks(document) -> tuple[int, list[tuple[int, bytes]]] | None:
    """The first page that has blocks, and these."""
    for index, page in enumerate(document.pages()):
        found = page_blocks(document, page)
        if found:
            return index, found
    return None

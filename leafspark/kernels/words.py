"""Words in text: which one an offset selects. Offsets count UTF-16 units, as the callers' strings do."""

from __future__ import annotations

import unicodedata

CONNECTORS = frozenset("'’-_")
SNAP = 3
_BODY = frozenset(("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Nl", "Mn", "Mc", "Me"))


def units(text: str) -> list[str]:
    """The UTF-16 units of text, as characters."""
    raw = text.encode("utf-16-le", "surrogatepass")
    return [chr(raw[k] | raw[k + 1] << 8) for k in range(0, len(raw), 2)]


def word_ranges(text: str) -> list[tuple[int, int]]:
    """Runs of letters, digits and marks; single connectors between two of those belong to the run. Japanese has no
    spaces: there a run ends where ideographs, hiragana, katakana and other letters meet."""
    return _ranges(text if _plain(text) else units(text))


def _plain(text: str) -> bool:
    """Whether every character is one unit."""
    return text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text)


def _body(char: str) -> bool:
    return unicodedata.category(char) in _BODY


def _script(char: str) -> str:
    """The part of Japanese writing that a character is of; empty for all others, a star for marks, which join any."""
    if "\u3041" <= char <= "\u3096":
        return "hiragana"
    if "\u30a1" <= char <= "\u30fa" or "\u31f0" <= char <= "\u31ff" or "\uff66" <= char <= "\uff9d":
        return "katakana"
    if "\u3400" <= char <= "\u9fff" or "\uf900" <= char <= "\ufaff" or char in "\u3005\u3006\u3007":
        return "ideographs"
    return "*" if char in "\u3099\u309a\u309b\u309c\u30fc" or unicodedata.category(char)[0] == "M" else ""


def _ranges(chars) -> list[tuple[int, int]]:
    body = [_body(c) for c in chars]
    out, at, n = [], 0, len(body)
    while at < n:
        if not body[at]:
            at += 1
            continue
        start = at
        while at < n and (body[at] or (chars[at] in CONNECTORS and at + 1 < n and body[at + 1])):
            at += 1
        out += _parts(chars, start, at) if any(c >= "\u3000" for c in chars[start:at]) else [(start, at)]
    return out


def _parts(chars, start: int, end: int) -> list[tuple[int, int]]:
    """A run cut where its script changes, but for at connectors."""
    out, script = [], ""
    for k in range(start, end):
        own = "*" if chars[k] in CONNECTORS else _script(chars[k])
        if own != "*" and own != script:
            if k > start and chars[k - 1] not in CONNECTORS:
                out.append((start, k))
                start = k
            script = own
    return [*out, (start, end)]


def word_at(text: str | None, offset: int) -> tuple[int, int] | None:
    """The word at an offset, its end included, or else the nearest within SNAP; the first of equals. Only what lies
    about the offset is looked at."""
    if not text:
        return None
    chars = text if _plain(text) else units(text)
    offset = max(0, min(offset, len(chars)))
    low, high = max(0, offset - SNAP - 1), min(len(chars), offset + SNAP + 1)
    inner = lambda c: c in CONNECTORS or _body(c)
    while low > 0 and inner(chars[low - 1]):
        low -= 1
    while high < len(chars) and inner(chars[high]):
        high += 1
    near = [(a + low, b + low) for a, b in _ranges(chars[low:high])]
    best = min(near, key=lambda r: max(r[0] - offset, offset - r[1], 0), default=None)
    return best if best and max(best[0] - offset, offset - best[1], 0) <= SNAP else None


def selected(text: str, span: tuple[int, int] | None) -> str:
    if not span:
        return ""
    if _plain(text):
        return text[span[0] : span[1]]
    return "".join(units(text)[span[0] : span[1]]).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

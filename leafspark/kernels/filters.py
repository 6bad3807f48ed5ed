"""Stream filters: Flate with predictors, ASCII hexadecimal, ASCII base 85, and chains of them."""

from __future__ import annotations

import re
import zlib

import numpy as np

from leafspark.kernels.objects import Ref, integer, name

MAX_INTERMEDIATE = 64 << 20
STEP = 4096
MAX_ROW = (1 << 31) - 1


def flate(data: bytes, strict: bool = False, limit: int | None = None) -> bytes | None:
    """Inflates; what came before an error or the early end stays unless strict. None beyond limit bytes.

    Output is taken in steps, and a step cut short by an error is lost."""
    if not data:
        return None if strict else b""
    try:
        whole = zlib.decompressobj()
        out = whole.decompress(data, (limit + 1) if limit is not None else 0)
        if limit is not None and len(out) > limit:
            return None
        if whole.eof:
            return out
        if limit is not None and whole.unconsumed_tail:
            return _steps(data, strict, limit)
        return None if strict else out
    except zlib.error:
        return _steps(data, strict, limit)


def _steps(data: bytes, strict: bool, limit: int | None) -> bytes | None:
    inflater, out, size, rest, failed = zlib.decompressobj(), [], 0, data, False
    while not inflater.eof:
        try:
            part = inflater.decompress(rest, STEP)
        except zlib.error:
            failed = True
            break
        rest = inflater.unconsumed_tail
        if not part:
            break
        size += len(part)
        if limit is not None and size > limit:
            return None
        out.append(part)
    if strict and (failed or not inflater.eof):
        return None
    return b"".join(out)


def ascii_hex(data: bytes) -> bytes:
    """Ignores what is no digit, stops at >, and pads an odd digit with 0."""
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.partition(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))


def ascii85(data: bytes) -> bytes:
    """Base 85, leniently: an optional <~, z for four zeros, an end at ~; other bytes are ignored, and so is a z within
    a group, which ends the data with what there is."""
    data = data.removeprefix(b"<~")
    out, group = bytearray(), []
    for c in data.partition(b"~")[0]:
        if c == 0x7A:
            if group:
                return bytes(out)
            out += bytes(4)
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                out += _base85(group)
                group = []
    if len(group) > 1:
        out += _base85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _base85(group: list[int]) -> bytes:
    value = 0
    for d in group:
        value = value * 85 + d
    return (value & 0xFFFFFFFF).to_bytes(4, "big")


class Predictor:
    """What DecodeParms say of rows; shape is None where they make no sense."""

    def __init__(self, parms: dict):
        self.kind = _of(parms, "Predictor", 1)
        self.colors, self.columns, self.bits = _of(parms, "Colors", 1), _of(parms, "Columns", 1), _of(parms, "BitsPerComponent", 8)
        self.sane = min(self.colors, self.columns, self.bits) > 0
        self.row = (self.colors * self.columns * self.bits + 7) // 8 if self.sane else 0
        self.pixel = (self.colors * self.bits + 7) // 8 if self.sane else 0
        if self.row > MAX_ROW:
            self.sane = False

    def inflated(self, limit: int | None) -> int | None:
        """The bytes that give limit bytes without the tags of PNG rows."""
        if limit is None or not 10 <= self.kind <= 15 or not self.sane:
            return limit
        most = limit // self.row * (self.row + 1)
        return most if most <= MAX_ROW else limit

    def undo(self, data: bytes) -> bytes | None:
        if self.kind <= 1:
            return data
        if not self.sane:
            return None
        if self.kind == 2:
            return _tiff(data, self)
        return _png(data, self.row, self.pixel) if 10 <= self.kind <= 15 else None


def _of(parms: dict, key: str, default: int) -> int:
    value = integer(parms.get(key))
    return default if value is None else value


def _tiff(data: bytes, p: Predictor) -> bytes | None:
    """Adds up each component along its row, modulo 2^bits."""
    if p.bits not in (1, 2, 4, 8, 16) or len(data) % p.row:
        return None
    rows = np.frombuffer(data, np.uint8).reshape(-1, p.row)
    n = p.columns * p.colors
    if p.bits == 8:
        return np.cumsum(rows.reshape(-1, p.columns, p.colors), axis=1, dtype=np.uint8).tobytes()
    if p.bits == 16:
        wide = np.frombuffer(data, ">u2").reshape(-1, p.columns, p.colors)
        return np.cumsum(wide, axis=1, dtype=np.uint16).astype(">u2").tobytes()
    out = []
    weights = 1 << np.arange(p.bits - 1, -1, -1, dtype=np.uint8)
    for row in rows:  # a row at a time: samples take eight times their bytes
        bits = np.unpackbits(row)
        samples = bits[: n * p.bits].reshape(n, p.bits) @ weights
        sums = np.cumsum(samples.reshape(p.columns, p.colors), axis=0, dtype=np.uint8).reshape(-1) & ((1 << p.bits) - 1)
        bits[: n * p.bits] = ((sums[:, None] & weights) > 0).reshape(-1)
        out.append(np.packbits(bits).tobytes())
    return b"".join(out)


def _png(data: bytes, row: int, pixel: int) -> bytes | None:
    """Undoes the tagged filter of each row."""
    if len(data) % (row + 1):
        return None
    out, above = [], bytes(row)
    rows = np.frombuffer(data, np.uint8).reshape(-1, row + 1)
    # Rows of one tag in turn are undone at once where they can be.
    ends = [*(np.flatnonzero(np.diff(rows[:, 0])) + 1).tolist(), len(rows)] if len(rows) else []
    for start, end in zip([0, *ends], ends):
        if data[start * (row + 1)] in (0, 2):
            run = rows[start:end, 1:]
            if rows[start, 0] == 2:
                run = run.copy()
                run[0] += np.frombuffer(above, np.uint8)
                run = np.cumsum(run, axis=0, dtype=np.uint8)
            out.append(run.tobytes())
            above = out[-1][-row:]
            continue
        for at in range(start * (row + 1), end * (row + 1), row + 1):
            tag, line = data[at], data[at + 1 : at + 1 + row]
            if tag not in (1, 3, 4):
                return None
            got = bytearray(line)
            for i in range(row):
                left = got[i - pixel] if i >= pixel else 0
                if tag == 1:
                    guess = left
                elif tag == 3:
                    guess = (left + above[i]) // 2
                else:
                    guess = _paeth(left, above[i], above[i - pixel] if i >= pixel else 0)
                got[i] = (got[i] + guess) & 0xFF
            above = bytes(got)
            out.append(above)
    return b"".join(out)


def _paeth(left: int, up: int, corner: int) -> int:
    guess = left + up - corner
    return min((left, up, corner), key=lambda x: abs(guess - x))


def decode(data: bytes, dictionary: dict, resolve=lambda ref: None, strict: bool = False, limit: int | None = None) -> bytes | None:
    """The data of a stream with this dictionary after its filters; None if one is unknown, fails, or exceeds limit."""

    def hop(value):
        return resolve(value) if isinstance(value, Ref) else value

    if limit is not None and limit < 0:
        return None
    entry = hop(dictionary["Filter"]) if "Filter" in dictionary else None
    if entry is None:
        return data if limit is None or len(data) <= limit else None
    filters = [name(entry)] if name(entry) else [name(hop(f)) for f in entry] if isinstance(entry, list) else [None]
    if None in filters:
        return None
    given = hop(dictionary.get("DecodeParms"))
    parms = [given] if isinstance(given, dict) else [hop(p) for p in given] if isinstance(given, list) else []
    for k, kind in enumerate(filters):
        own = parms[k] if k < len(parms) and isinstance(parms[k], dict) else {}
        most = limit if k == len(filters) - 1 else None if limit is None else MAX_INTERMEDIATE
        if kind in ("FlateDecode", "Fl"):
            predictor = Predictor(own) if own else None
            data = flate(data, strict, predictor.inflated(most) if predictor else most)
            data = None if data is None else predictor.undo(data) if predictor else data
        elif kind in ("ASCIIHexDecode", "AHx"):
            data = ascii_hex(data)
        elif kind in ("ASCII85Decode", "A85"):
            data = ascii85(data)
        else:
            return None
        if data is None or (most is not None and len(data) > most):
            return None
    return data

"""Page text from content streams: operators in stream order, with line breaks by height."""

from __future__ import annotations

from ctypes import c_float

from leafspark.kernels.fonts import Font, Fonts
from leafspark.kernels.objects import BLANK, TOKEN, Lexer, PdfError, number

LINE_STEP, SPACE_KERN = 5.0, -100.0


def operations(data: bytes):
    """(operator, operands) in order. Dictionaries are skipped, but in an array their marks alone are; stray closing
    marks are ignored, and arrays may nest."""
    lexer, operands = Lexer(data), []
    stack: list[list] = []
    match, at = TOKEN.match, 0
    while True:
        m = match(data, at)
        found = m.lastindex
        if found == 5 or (found == 1 and m.end(1) - m.start(1) < 19):
            (stack[-1] if stack else operands).append(m[5] if found == 5 else int(m[1]))
            at = m.end()
            continue
        if found == 3 and not stack:
            at = m.end()
            yield m[3].decode("latin-1"), operands
            operands = []
            continue
        lexer.at = at
        token = lexer.next()
        at = lexer.at
        if token is None:
            return
        into = stack[-1] if stack else operands
        kind = token.kind
        if kind in ("int", "real", "name", "string", "hex"):
            into.append(token.value)
        elif kind == "[":
            stack.append([])
        elif kind == "]":
            if stack:
                done = stack.pop()
                (stack[-1] if stack else operands).append(done)
        elif kind == "<<" and not stack:
            _skip(lexer)
            at = lexer.at
        elif kind == "word" and not stack:
            yield token.value, operands
            operands = []


def _skip(lexer: Lexer) -> None:
    depth = 1
    while depth:
        token = lexer.next()
        if token is None:
            return
        depth += (token.kind == "<<") - (token.kind == ">>")


def _f32(value: float) -> float:
    """Rounded to 32 bits: where lines break depends on it."""
    if -16777216.0 <= value <= 16777216.0 and value == int(value):
        return value + 0.0
    return c_float(value).value


class Interpreter:
    """The state that text operators change. Positions (32-bit floats) serve to tell lines apart; text stays in stream
    order."""

    def __init__(self, font_of):
        self.font_of = font_of
        self.out: list[str] = []
        self.last = ""
        self.font: Font | None = None
        self.size, self.leading, self.x, self.y = 1.0, 0.0, 0.0, 0.0
        self.line: float | None = None
        self.gap = False

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.last = text[-1]

    def _break(self) -> None:
        if self.last and self.last != "\n":
            self._put("\n")

    def _moved(self) -> None:
        if self.line is not None and abs(_f32(self.line - self.y)) > LINE_STEP:
            self._break()
            self.line, self.gap = self.y, False

    def _feed(self) -> None:
        self.x = 0.0
        self.y = _f32(self.y - (self.leading or self.size))
        self._moved()

    def _show(self, data: bytes) -> None:
        text = self.font.decode(data) if self.font else data.decode("latin-1")
        if not text:
            return
        if self.gap and self.last and self.last not in BLANK:
            self._put(" ")
        self.gap = False
        self._put(text)
        if self.line is None:
            self.line = self.y

    def run(self, operator: str, operands: list) -> None:
        def pop(default: float = 0.0) -> float:
            got = number(operands.pop()) if operands else None
            return default if got is None else _f32(got)

        if operator == "Tj":
            if operands and isinstance(operands[-1], bytes):
                self._show(operands[-1])
        elif operator == "TJ":
            for item in operands[-1] if operands and isinstance(operands[-1], list) else []:
                if isinstance(item, bytes):
                    self._show(item)
                elif number(item) is not None and item <= SPACE_KERN:
                    self.gap = True
        elif operator == "Td" or operator == "TD":
            ty, tx = pop(), pop()
            if operator == "TD":
                self.leading = -ty
            self.x, self.y = _f32(self.x + tx), _f32(self.y + ty)
            self._moved()
        elif operator == "Tm":
            self.y = pop()
            self.x = pop()
            self._moved()
        elif operator == "T*":
            self._feed()
        elif operator == "'" or operator == '"':
            self._feed()
            if operands and isinstance(operands[-1], bytes):
                self._show(operands[-1])
        elif operator == "Tf":
            self.size = pop(1.0)
            key = operands.pop() if operands else None
            self.font = self.font_of(str(key)) if isinstance(key, str) else None
        elif operator == "TL":
            self.leading = pop()
        elif operator == "BT":
            self.x = self.y = 0.0
            self.line = None
        elif operator == "ET":
            self._break()
            self.line = None

    def text(self) -> str:
        """What was shown, trimmed; halves of surrogate pairs that fonts gave apart are joined, odd ones replaced."""
        return whole("".join(self.out).strip(BLANK))


def whole(text: str) -> str:
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def page_text(document, page) -> str:
    """The text of a page; empty where its contents cannot be read. What precedes bad syntax stays."""
    try:
        data = document.contents(page)
    except PdfError:
        return ""
    if not data:
        return ""
    state = Interpreter(Fonts(document, page.resources).get)
    try:
        for operator, operands in operations(data):
            state.run(operator, operands)
    except PdfError:
        pass
    return state.text()


def sorted_text(document, page) -> str:
    """An extension: lines from top to bottom, pieces of a line from left to right."""
    try:
        data = document.contents(page)
    except PdfError:
        return ""
    state, pieces = Interpreter(Fonts(document, page.resources).get), []
    try:
        for operator, operands in operations(data or b""):
            before = len(state.out)
            state.run(operator, operands)
            text = "".join(state.out[before:]).strip(BLANK) if len(state.out) > before else ""
            if text:
                pieces.append((-state.y, state.x, len(pieces), text))
    except PdfError:
        pass
    lines: list[tuple[float, list]] = []
    for y, x, k, text in sorted(pieces):
        if lines and abs(lines[-1][0] - y) <= LINE_STEP:
            lines[-1][1].append((x, k, text))
        else:
            lines.append((y, [(x, k, text)]))
    return whole("\n".join(" ".join(t for _, _, t in sorted(line)) for _, line in lines))



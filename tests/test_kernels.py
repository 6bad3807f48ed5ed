"""The byte kernels on documents written by hand."""

import base64
import random
import zlib

import pytest

from leafspark.kernels import annotate, blocks, build, content, document, filters, fonts, outline, words
from leafspark.kernels.objects import NULL, Lexer, Name, PdfError, Ref, escape_literal, escape_name, format_number, parse_bytes, parse_object, serialize, text_string
from leafspark.plans import fixtures


def texts(data):
    d = document.open_document(data)
    return [content.page_text(d, p) for p in d.pages()]


def shown(stream, fonts_=None):
    return texts(build.text_pdf([stream], fonts_))[0]


# -- syntax


def test_objects():
    data = rb"<< /A#42 [1 -2 +3 .5 4. true null 7 0 R (a\(b\)\\\n\101\7(x)\q) <48 6> ] % note" + b"\r\n /D << >> >>"
    got = parse_bytes(data)
    assert got == {"AB": [1, -2, 3, 0.5, 4.0, True, NULL, Ref(7, 0), b"a(b)\\\nA\x07(x)q", b"H`"], "D": {}}
    assert type(parse_bytes(b"/Name")) is Name


@pytest.mark.parametrize("bad", [b"", b"<<", b"[1", b"(open", b"<4", b"<zz>", b"]", b"obj", b"<< 1 2 >>", b"[" * 500])
def test_bad_objects_raise(bad):
    with pytest.raises(PdfError):
        parse_bytes(bad)


def test_text_forms():
    assert [format_number(x) for x in (0.00005, -0.0, 3.0, 1.25, -2.00004, 0.12345, 1e6)] == ["0", "0", "3", "1.25", "-2", "0.1235", "1000000"]
    assert escape_literal("a(b)\\\n\r\t") == "a\\(b\\)\\\\\\n\\r\\t"
    assert escape_name("a b#/é") == "a#20b#23#2F#E9"
    assert serialize({"K": [1, 2.5, Name("x y"), b"Hi", NULL, True, Ref(3, 0)]}) == "<</K [1 2.5 /x#20y <4869> null true 3 0 R]>>"
    assert [text_string(b) for b in (b"\xfe\xff\x00A\xd8\x3d\xde\x00", b"\xff\xfeA\x00", b"\xe9")] == ["A\U0001f600", "A", "é"]


def test_numbers_out_of_range_are_bad_syntax():
    assert parse_bytes(b"[9223372036854775807 -9223372036854775808 000000000000000000000000000007]") == [2**63 - 1, -(2**63), 7]
    for bad in (b"9223372036854775808", b"-" + b"9" * 5000, b"1" + b"0" * 400 + b".", b"7" * 5000):
        with pytest.raises(PdfError):
            parse_bytes(bad)
    assert parse_bytes(b"[3000000000 0 R 1 3000000000 R]") == [Ref(0, 0), Ref(1, 0)]


def test_ties_of_numbers_go_up():
    assert [format_number(x) for x in (0.03125, -0.03125, 2.00005, 1e30, float("inf"), float("nan"))] == ["0.0313", "-0.0313", "2.0001", "1" + "0" * 30, "Infinity", "NaN"]


def test_lexer_offsets():
    lexer = Lexer(b"  12 /a%c\n(b)")
    assert [(t.kind, t.offset) for t in iter(lexer.next, None)] == [("int", 2), ("name", 5), ("string", 10)]


# -- contents


def test_heights_are_32_bits():
    line = lambda y1, y2: shown(f"BT /F1 9 Tf 1 0 0 1 0 {y1} Tm (a) Tj 1 0 0 1 0 {y2} Tm (b) Tj ET".encode())
    assert line(128.3, 123.3) == "ab" and line(128.3, 123.2) == "a\nb" and line(5, 0) == "ab"


def test_dictionaries_in_arrays_keep_their_values():
    assert shown(b"BT /F1 9 Tf [(a) << /k (b) >> (c)] TJ << /k (x) >> (d) Tj ET") == "abcd"


# -- filters


def test_flate_keeps_what_came_before_an_error():
    data = random.Random(1).randbytes(20000)
    packed = zlib.compress(data)
    assert filters.flate(packed) == data == filters.flate(packed, strict=True)
    cut = filters.flate(packed[:-3000])
    assert cut and data.startswith(cut) and filters.flate(packed[:-3000], strict=True) is None
    broken = packed[:-4] + b"\0\0\0\0"
    assert len(filters.flate(broken)) % 4096 == 0 and filters.flate(broken, strict=True) is None
    assert filters.flate(b"junk") == b"" and filters.flate(packed, limit=19999) is None and filters.flate(packed, limit=20000) == data


def test_ascii_filters():
    assert filters.ascii_hex(b"4 8x6>99") == b"H`"
    for n in range(9):
        raw = bytes(range(200, 200 + n))
        assert filters.ascii85(base64.a85encode(raw, adobe=True)) == raw
    assert filters.ascii85(b"z!!!!!~>") == bytes(8) and filters.ascii85(b"!z") == b"" and filters.ascii85(b"5s~>") == b"A"


def test_chain_and_limits():
    raw = b"abc" * 100
    packed = base64.a85encode(zlib.compress(raw)) + b"~>"
    chain = {"Filter": [Name("A85"), Name("Fl")]}
    assert filters.decode(packed, chain) == raw == filters.decode(packed, chain, limit=300)
    assert filters.decode(packed, chain, limit=299) is None and filters.decode(packed, {"Filter": Name("LZWDecode")}) is None
    assert filters.decode(raw, {}, limit=10) is None and filters.decode(raw, {"Filter": Ref(1, 0)}, lambda r: Name("AHx")) == b"\xab\xca\xbc" * 50


def png(rows, tags, pixel):
    out, above = b"", bytes(len(rows[0]))
    for row, tag in zip(rows, tags):
        left = lambda i: row[i - pixel] if i >= pixel else 0
        corner = lambda i: above[i - pixel] if i >= pixel else 0

        def paeth(i):
            p = left(i) + above[i] - corner(i)
            return sorted((abs(p - x), k, x) for k, x in enumerate((left(i), above[i], corner(i))))[0][2]

        guess = {0: lambda i: 0, 1: left, 2: lambda i: above[i], 3: lambda i: (left(i) + above[i]) // 2, 4: paeth}[tag]
        out += bytes([tag]) + bytes((row[i] - guess(i)) & 255 for i in range(len(row)))
        above = row
    return out


def test_png_predictors():
    r = random.Random(2)
    rows = [r.randbytes(12) for _ in range(10)]
    parms = {"Predictor": 15, "Colors": 3, "Columns": 4}
    data = zlib.compress(png(rows, [0, 1, 2, 3, 4] * 2, 3))
    assert filters.decode(data, {"Filter": Name("Fl"), "DecodeParms": parms}, limit=120) == b"".join(rows)
    assert filters.Predictor(parms).undo(b"\x05" + bytes(12)) is None and filters.Predictor(parms).undo(bytes(14)) is None
    assert filters.Predictor({"Predictor": 9}).undo(b"a") is None and filters.Predictor({"Predictor": 12, "Colors": 0}).undo(b"a") is None


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16])
def test_tiff_predictor(bits):
    r, columns, colors = random.Random(bits), 7, 3
    row = [r.randrange(1 << bits) for _ in range(columns * colors)]
    deltas = [(v - (row[i - colors] if i >= colors else 0)) % (1 << bits) for i, v in enumerate(row)]

    def packed(values):
        joined = "".join(f"{v:0{bits}b}" for v in values)
        return int(joined.ljust(-(-len(joined) // 8) * 8, "0"), 2).to_bytes(-(-len(joined) // 8), "big")

    p = filters.Predictor({"Predictor": 2, "Colors": colors, "Columns": columns, "BitsPerComponent": bits})
    assert p.undo(packed(deltas) * 2) == packed(row) * 2 and p.undo(packed(deltas) + b"x") is None


# -- structure


def test_header_tail_and_trailer():
    data = fixtures.text_pdf("hello")
    assert texts(data) == ["hello"] == texts(data + b"\0" * 8192) == texts(data.replace(b"trailer\n<<", b"trailer<<"))
    assert texts(data + b"\nstartxref\n5\n%%EOF\nstartxref 99999999") == ["hello"]
    for bad in (b"", b"%PDF-1.4", data[:300], data.replace(b"%PDF-", b"%XDF-"), data + b"\0" * (1 << 20), data.replace(b"/Root 1", b"/Encrypt 9 0 R /Root 1")):
        with pytest.raises(PdfError):
            document.open_document(bad)


@pytest.mark.parametrize("flate, predictor", [(True, False), (True, True), (False, False)])
def test_packed_objects(flate, predictor):
    packed = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>"}
    data = build.compressed({4: build.flate_stream(build.lines_content("in"))}, packed, flate=flate, predictor=predictor)
    assert texts(data) == ["in"]
    d = document.open_document(data)
    assert d.next_number(1) == 7 and d.object_stream(5, 20) is None and len(d.object_stream(5)) == 3
    assert {e.kind for e in d.packed.values()} == {"compressed"}
    for bad in (data.replace(b"/W [1 4 2]", b"/W [1 4 9]"), data.replace(b"/Size 7", b"/Size 9"), data.replace(b"/Type /XRef", b"/Type /XXXX")):
        with pytest.raises(PdfError):
            document.open_document(bad)


def test_wrong_places_in_object_streams():
    packed = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [] >>"}
    data = build.compressed({3: b"null"}, packed, flate=False)
    assert document.open_document(data).resolve(Ref(1, 0))
    assert document.open_document(data.replace(b"1 0 2 34\n", b"9 0 2 34\n")).resolve(Ref(1, 0)) is None
    assert document.open_document(data.replace(b"/N 2", b"/N 3")).resolve(Ref(2, 0)) is None


def test_newer_sections_hide_older_ones():
    old = document.Section({(1, 0): document.Entry("in_use", 10, rank=1), (2, 0): document.Entry("in_use", 20, rank=1)}, {(3, 0): document.Entry("compressed", 5, 0, 1)}, {"Size": 4, "Info": 1})
    new = document.Section({(2, 1): document.Entry("free", 0), (3, 0): document.Entry("in_use", 30)}, {}, {"Size": 5})
    got = new.over(old)
    assert set(got.entries) == {(1, 0), (2, 1), (3, 0)} and not got.packed and got.trailer == {"Size": 5, "Info": 1}


def test_cycles_end():
    data = fixtures.text_pdf("x")
    start = data.rsplit(b"startxref\n", 1)[1].split()[0]
    assert texts(data.replace(b"/Size 102", b"/Prev " + start + b" /Size 102")) == ["x"]
    looped = build.classic({1: b"<< /Pages 2 0 R >>", 2: b"<< /Kids [2 0 R 3 0 R 3 0 R << /Type /Page >>] >>", 3: b"<< /Type /Page >>"})
    assert len(document.open_document(looped).pages()) == 2
    assert document.open_document(build.classic({1: b"<< >>", 2: b"2 0 R"})).resolve(Ref(2, 0)) in (None, Ref(2, 0))


def test_contents():
    extra = {110: build.stream(b"BT (a) Tj ET"), 111: b"<< /Length 112 0 R /Filter [/AHx] >>\nstream\r\n" + b"BT (b) Tj ET".hex().encode() + b">\nendstream", 112: b"25"}
    page = lambda contents: {100: f"<< /Type /Page /Contents {contents} >>".encode()}
    made = lambda contents: texts(build.text_pdf([b""], extra={**extra, **page(contents)}))
    assert made("[110 0 R (no) 111 0 R]") == ["a\nb"] and made("[110 0 R 199 0 R]") == [""] and made("(no)") == [""]
    long = build.text_pdf([b""], extra={101: b"<< /Length 999999 >>\nstream\nBT (a) Tj ET\nendstream"})
    assert texts(long) == [""] and texts(build.text_pdf([b""], extra={101: b"<< /Length 0 >>\nstream\n\nendstream"})) == [""]


# -- text


def test_operators():
    assert shown(b"BT /F1 12 Tf (a) Tj 0 -5 Td (b) Tj 0 -1 Td (c) Tj ET BT (d) Tj ET") == "ab\nc\nd"
    assert shown(b"BT (a) Tj 12 TL T* (b) Tj (c) ' 1 2 (d) \" 0 -20 TD (e) Tj T* (f) Tj ET") == "a\nb\nc\nd\ne\nf"
    assert shown(b"BT [(a) -99 (b) -100 (c) -250.5 ( d) 500 (e)] TJ ET") == "ab c  de"
    assert shown(b"BT 1 0 0 1 0 700 Tm (a) Tj 1 0 0 1 50 700 Tm (b) Tj 9 0 0 9 0 690 Tm (c) Tj ET") == "ab\nc"
    assert shown(b"BT (a) Tj /x << /y (n) >> BDC ] [[(q)] 1] d0 (b) Tj ET") == "ab"
    assert shown(b"BT /Nope 9 Tf (\351) Tj ET") == "é" and shown(b"BT (kept) Tj ET <zz") == "kept" and shown(b"BT (\\240 x \\t) Tj ET") == "x"


def test_a_drift_of_small_steps_breaks_against_the_last_break():
    assert shown(b"BT (a) Tj 0 -3 Td (b) Tj 0 -3 Td (c) Tj 0 -3 Td (d) Tj ET") == "ab\ncd"


def test_encodings():
    assert fonts.ENCODINGS["WinAnsiEncoding"][0x80] == 0x20AC and not fonts.ENCODINGS["WinAnsiEncoding"][0x81]
    assert fonts.ENCODINGS["MacRomanEncoding"][0x80] == 0xC4 and fonts.ENCODINGS["MacRomanEncoding"][0xDB] == 0x20AC
    assert fonts.ENCODINGS["PDFDocEncoding"][0x18] == 0x2D8 and not fonts.ENCODINGS["StandardEncoding"][0xA1]
    names = {"A": 65, "zero": None, "7": 55, "Agrave": 0xC0, "oslash": 0xF8, "aring": 0xE5, "ydieresis": 0xFF, "Zcaron": 0x17D, "uni00e9": 0xE9, "uni00410042": 0x41, "u1F600": 0x1F600, "uXYZW": None, "uni12": None, "quoteright": 0x2019, "one": None, "ntilde": 0xF1, "ccedilla": 0xE7}
    for n, c in names.items():
        assert fonts.glyph_code(n) == c, n


def test_fonts():
    differ = b"<< /Subtype /Type1 /Encoding << /BaseEncoding /MacRomanEncoding /Differences [65 /eacute /nosuch 200 /Euro] >> >>"
    assert shown(b"BT /F1 9 Tf (ABC\\200\\310) Tj ET", {3: differ}) == "éCÄ€"
    assert shown(b"BT /F1 9 Tf (\\200\\201) Tj ET") == "€\x81" and shown(b"BT /F1 9 Tf (\\200) Tj ET", {3: b"<< /Encoding /MacRomanEncoding >>"}) == "Ä"
    assert shown(b"BT /F1 9 Tf <00410042> Tj ET", {3: b"<< /Subtype /Type0 >>"}) == "AB"


def test_cmaps():
    m = fonts.parse_cmap(b"begincodespacerange <0000> <ffff> endcodespacerange beginbfchar <01> <0041> <0002> <D83DDE00> <03> <004> endbfchar beginbfrange <10> <12> <0061> <0020> <0021> [<0078> <0079007A> <00>] <30> <31> <D83DDE00> endbfrange")
    assert m.width == 2 and m.single.all() == {1: "A", 3: "", 16: "a", 17: "b", 18: "c"} and m.double.all() == {2: "\U0001f600", 32: "x", 33: "yz"}
    assert m.get(2, 1) == "\U0001f600" and m.get(1, 2) == "A" and m.get(9, 1) is None
    for beyond in (b"<01> <02> <00660066>", b"<0000> <7fffff> <0041>", b"<0000> <FFFFFF> <0041>"):
        with pytest.raises(ValueError):
            fonts.parse_cmap(b"beginbfrange " + beyond + b" endbfrange")


def test_wide_ranges_hide_and_are_hidden():
    m = fonts.parse_cmap(b"beginbfchar <0005> <0078> endbfchar beginbfrange <000000> <0FFFFF> <0041> <0007> <0008> <0030> <0100> <0300> <0061> endbfrange")
    plain = {5: "x"} | {c: chr(0x41 + c) for c in range(1 << 20)} | {7: "0", 8: "1"} | {c: chr(0x61 + c - 0x100) for c in range(0x100, 0x301)}
    assert m.double.all() == plain and m.get(1 << 20, 2) is None and m.single.all() == {}


def test_two_byte_text_with_an_odd_byte():
    font = fonts.Font(2, fonts.CMap(width=2))
    font.cmap.single.set(0x41, "s")
    font.cmap.double.set(0x4142, "d")
    assert font.decode(b"AB" b"A") == "ds" and font.decode(b"\x00\x99") == ""
    assert texts(build.unicode_pdf("Ελ \U0001f600\nж")) == ["Ελ \U0001f600\nж"]


# -- files of odd shapes


def packed_file(more=b"", width=b"1 4 2", kinds=(), stream_word=b"stream", size=None, length=None):
    """A catalog and an empty page tree behind a cross-reference stream written by hand; kinds are extra entries."""
    out = bytearray(b"%PDF-1.5\n")
    offsets = {}
    for num, body in {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [] >>"}.items():
        offsets[num] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (num, body)
    widths = list(map(int, width.split()))
    entry = lambda *v: b"".join(x.to_bytes(w, "big") for x, w in zip(v, widths))
    rows = entry(0, 0, 0) + entry(1, offsets[1], 0) + entry(1, offsets[2], 0) + entry(1, len(out), 0) + b"".join(entry(*k) for k in kinds)
    head = b"<< /Type /XRef /Size %d /W [%s] /Root 1 0 R /Length %d %s >>" % (size or 4 + len(kinds), width, length or len(rows), more)
    return bytes(out) + b"3 0 obj\n" + head + b"\n" + stream_word + b"\n" + rows + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % len(out)


def test_odd_cross_reference_streams():
    opens = lambda data: document.open_document(data).pages() == []
    assert opens(packed_file()) and opens(packed_file(stream_word=b"% a comment\nstream"))
    wide = document.open_document(packed_file(width=b"2 4 2", kinds=[(258, 7, 7), (2, 9, 1)]))
    assert (4, 0) not in wide.entries and wide.packed[5, 0].a == 9  # a kind that is not known does not count
    for bad in (packed_file(length=70_000_000), packed_file(size=100_001), packed_file(width=b"1 9 2"), packed_file(stream_word=b"straem"), packed_file(more=b"/Filter /FlateDecode")):
        with pytest.raises(PdfError):
            document.open_document(bad)


def test_exhausted_numbers_leave_a_document_as_it_is():
    full = fixtures.text_pdf("a").replace(b"/Size 102", b"/Size 2147483647")
    note = {"seq": 1, "kind": "note", "page_index": 0, "x": 1.0, "y": 1.0, "contents": "n"}
    assert document.open_document(full).next_number(1) is None and annotate.append(full, [note]) == full
    assert annotate.append(fixtures.text_pdf("a"), [note]) != fixtures.text_pdf("a")


def test_object_streams_out_of_bounds(monkeypatch):
    packed = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [] >>"}
    data = build.compressed({3: b"null"}, packed, flate=False)
    assert len(document.open_document(data).object_stream(4)) == 2
    for change in ((b"/N 2", b"/N 9"), (b"/Type /ObjStm", b"/Type /ObjXxx")):
        assert document.open_document(data.replace(*change)).object_stream(4) is None
    monkeypatch.setattr(document, "MAX_OBJECTS", 1)
    assert document.open_document(data).object_stream(4) is None


# -- outlines


def tree(data):
    to = lambda items: [(i.title, i.page, to(i.children)) if i.children else (i.title, i.page) for i in items]
    return to(outline.Outline(document.open_document(data)).items())


def outlined(items, catalog="", extra=None):
    objects = {900: b"<< /First 901 0 R >>", **{901 + k: v.encode("latin-1") for k, v in enumerate(items)}, **(extra or {})}
    return build.text_pdf([b"", b""], extra=objects, catalog=" /Outlines 900 0 R" + catalog)


def test_outline_tree():
    data = outlined(["<< /Title (One) /Dest [100 0 R /Fit] /First 903 0 R /Next 902 0 R >>", "<< /Title <FEFF00C9> /A << /D [102 0 R] >> /Next 901 0 R >>", "<< /Title ( sub ) /Dest [99] >>"])
    assert tree(data) == [("One", 0, [("sub", 1)]), ("É", 1)]


def test_outline_actions_and_blank_titles():
    items = [
        "<< /Title (first) /A << /S /Named /N /FirstPage >> /Next 902 0 R >>",
        "<< /Title (last) /A << /S /Named /N /LastPage >> /Next 903 0 R >>",
        "<< /Title (  ) /Dest [100 0 R] /First 901 0 R /Next 904 0 R >>",
        "<< /Title (far) /A << /S /GoToR /D [0] >> /Next 905 0 R >>",
        "<< /Title (neg) /Dest [-1] /A << /S /Named /N /FirstPage >> /Next 906 0 R >>",
        "<< /Title (next) /A << /S /Named /N /NextPage >> >>",
    ]
    assert tree(outlined(items)) == [("first", 0), ("last", 1), ("far", None), ("neg", None), ("next", None)]


def test_named_destinations():
    items = ["<< /Title (a) /Dest /old /Next 902 0 R >>", "<< /Title (b) /Dest (new) /Next 903 0 R >>", "<< /Title (c) /Dest (loop) /Next 904 0 R >>", "<< /Title (d) /Dest (none) >>"]
    extra = {950: b"<< /Kids [951 0 R 950 0 R] >>", 951: b"<< /Names [(new) << /D [102 0 R] >> (loop) (loop) (old) [102 0 R] (new) [100 0 R]] >>"}
    data = outlined(items, " /Dests << /old [100 0 R] >> /Names << /Dests 950 0 R >>", extra)
    assert tree(data) == [("a", 0), ("b", 1), ("c", None), ("d", None)]


def test_rows_of_a_deep_outline():
    items = [f"<< /Title (t{k}) /First {902 + k} 0 R >>" for k in range(1500)]
    got = outline.rows(outline.Outline(document.open_document(outlined(items))).items())
    assert len(got) == 1500 and got[-1][2] == 1500 and got[5][1] == 4


# -- annotations


def note(**more):
    return {"kind": "note", "page_index": 0, "x": 1.5, "y": 2, "red": 1, "green": 0.25, "blue": -3, "contents": " hi (é→) "} | more


def test_append_and_read_again():
    data = build.text_pdf([build.lines_content("one"), build.lines_content("two")], extra={102: b"<< /Type /Page /MediaBox [0 100 612 400] /Contents 103 0 R /Annots [50 0 R] /Lang (x) >>"})
    rects = [{"left": 10, "top": 20, "right": 5, "bottom": 40}, {"left": 0, "top": 0, "right": 0, "bottom": 9}]
    got = annotate.append(data, [note(page_index=1, kind="highlight", rects=rects, contents="  "), note(), note(page_index=9), note(page_index=1, kind="highlight", rects=rects[1:])])
    assert got.startswith(data) and texts(got) == ["one", "two"]
    d = document.open_document(got)
    first, second = d.pages()
    assert serialize(d.deref(second.dictionary["Annots"][1])) == "<</Type /Annot /Subtype /Highlight /Rect [5 260 10 280] /QuadPoints [5 280 10 280 5 260 10 260] /C [1 0.25 0] /F 4>>"
    assert second.dictionary["Lang"] == b"x" and second.dictionary["Annots"][0] == Ref(50, 0)
    sticky = d.deref(first.dictionary["Annots"][0])
    assert sticky["Contents"] == b"hi (\xe9?)" and sticky["Rect"] == [1.5, 768, 23.5, 790] and sticky["Open"] is False
    assert [r.num for r in (second.dictionary["Annots"][1], first.dictionary["Annots"][0])] == [104, 105] and d.trailer["Size"] == 106
    assert texts(annotate.append(got, [note()])) == ["one", "two"]


def test_nothing_to_append():
    data = fixtures.text_pdf("x")
    full = data.replace(b"/Size 102", b"/Size 2147483647")
    for d, notes in ((data, []), (data, [note(page_index=5)]), (b"no pdf", [note()]), (full, [note()]), (data, [note(kind="highlight", rects=[])])):
        assert annotate.append(d, notes) == d


def test_sections():
    runs = annotate.sections([Ref(5, 0), Ref(3, 0), Ref(4, 0), Ref(6, 1), Ref(9, 0)])
    assert [[r.num for r in run] for run in runs] == [[3, 4, 5], [6], [9]]


# -- private blocks


def test_blocks_by_number():
    data = fixtures.blocks_pdf([f"b{k}" for k in range(12)])
    d = document.open_document(data)
    assert [b.decode() for _, b in blocks.page_blocks(d, d.pages()[1])] == [f"b{k}" for k in range(12)]
    assert blocks.first_blocks(d)[0] == 1 and blocks.page_blocks(d, d.pages()[0]) == []
    odd = build.text_pdf([b""], extra={100: b"<< /Type /Page /PieceInfo << /Illustrator << /Private << /NumBlock 9 /AIPrivateData01 (z) /AIPrivateData3 (c) /AIPrivateData2 77 0 R /Other (x) >> >> >> >>"})
    d = document.open_document(odd)
    assert blocks.page_blocks(d, d.pages()[0]) == [(3, b"c")]


# -- words


def test_japanese_words_end_where_scripts_meet():
    cut = lambda t: [t[a:b] for a, b in words.word_ranges(t)]
    assert cut("私はカタカナーです。東京2020年の本") == ["私", "は", "カタカナー", "です", "東京", "2020", "年", "の", "本"]
    assert cut("日本-語 é\u0301a 한국어 か\u3099き PDF版") == ["日本-語", "é\u0301a", "한국어", "か\u3099き", "PDF", "版"]
    assert words.selected("東京タワー", words.word_at("東京タワー", 4)) == "タワー"


def test_words_near_an_offset_are_those_of_the_whole_text():
    r = random.Random(7)
    for _ in range(3000):
        text = "".join(r.choice("ab1é -_'’.\n\u0301日\U0001f600" if r.random() < 0.5 else "ab -'") for _ in range(r.randrange(1, 50)))
        offset = r.randrange(-2, 60)
        ranges, o = words.word_ranges(text), max(0, min(offset, len(words.units(text))))
        best = min(ranges, key=lambda x: max(x[0] - o, o - x[1], 0), default=None)
        assert words.word_at(text, offset) == (best if best and max(best[0] - o, o - best[1], 0) <= words.SNAP else None)


def test_words():
    at = lambda t, o: words.selected(t, words.word_at(t, o))
    assert [at("Clear  saved", o) for o in (2, 5, 6, 7, -4, 99)] == ["Clear", "Clear", "Clear", "saved", "Clear", "saved"]
    assert at("I don’t know", 4) == "don’t" and at("a-b_c--d", 2) == "a-b_c" and at("•••", 1) == "" and at("", 0) == "" and at(None, 0) == ""
    assert at("far        away", 8) == "away" and at("x          ", 9) == "" and at("\U0001f600 é1", 3) == "é1"


def test_usual_syntax_is_not_read_token_by_token(monkeypatch):
    """A dictionary, and most of a content stream, take no call for each token."""
    made, calls, step = fixtures.text_pdf("one\ntwo\nthree"), [0], Lexer.next
    def counted(lexer):
        calls[0] += 1
        return step(lexer)
    monkeypatch.setattr(Lexer, "next", counted)
    assert texts(made) == ["one\ntwo\nthree"] and calls[0] <= 5


def test_usual_and_other_syntax_read_alike(monkeypatch):
    parts = [b"<<", b">>", b"[", b"]", b"/A", b"/B#41", b"1", b"-2", b"+3", b"4 0 R", b"4 +0 R", b"1.5", b"true", b"null", b"R", b"(x)", b"(a(b))", b"<4>", b"<41>", b"%c\n", b"99999999999 0 R", b"1" + b"0" * 400 + b".0", b"nullx", b"5 0 RG", b"7 0 R/C"]
    r = random.Random(3)
    bodies = [r.choice([b"<</K ", b"[", b"<</A 1 /B ", b"[["]) + r.choice([b" ", b""]).join(r.choice(parts) for _ in range(r.randrange(1, 6))) + r.choice([b">>", b"]", b"]]"]) for _ in range(4000)]

    def read(body):
        lexer = Lexer(body)
        try:
            return parse_object(lexer), lexer.at
        except PdfError:
            return None

    bodies += [b + r.choice([b"endobj", b" stream"]) for b in bodies]
    got = [read(b) for b in bodies]
    monkeypatch.setattr("leafspark.kernels.objects._usual", lambda data, at: None)
    assert got == [read(b) for b in bodies] and sum(g is not None for g in got) > 300


def test_rows_of_png_are_undone_at_once(monkeypatch):
    """Rows of one tag in turn take one step of arrays, not one for each row."""
    data, steps, total = bytes(range(256)) * 500, [0], filters.np.cumsum
    def counted(*a, **k):
        steps[0] += 1
        return total(*a, **k)
    monkeypatch.setattr(filters.np, "cumsum", counted)
    assert filters._png(build.png_up(data, 8), 8, 1) == data and steps[0] == 1

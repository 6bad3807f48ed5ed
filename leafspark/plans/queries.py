"""Every operator over the driver's tables. What holds no PDFs is rendered to some first, and read back."""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.functions import geometry as geo
from leafspark.functions import render, text
from leafspark.kernels import build
from leafspark.operators import pdf, selection
from leafspark.operators.kernel import per_row
from leafspark.plans import fixtures
from leafspark.plans.fixtures import pdfs, table
from leafspark.sources.pdf import record_telemetry, slice_bytes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_TRIM = r"[\t\n\x0B\f\r\x1C-\x1F\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# Blank lines leave no line of their own, and ends are trimmed.
def _shown(column: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({column}, '\n+', chr(10), 'g'), '^{_TRIM}', ''), '{_TRIM}$', '')"


# -- text


@query(f"SELECT doc_id, 0 AS page_index, {_shown('text')} AS text FROM documents")
def text_roundtrip(spark, sf_dir):
    """One-byte text in Flate streams."""
    return pdf.page_text(pdfs(table(spark, sf_dir, "documents").select("doc_id", "text"), fixtures.text_pdf))


@query(f"SELECT conv_id, turn, {_shown('text')} AS text FROM conversations")
def text_roundtrip_cmap(spark, sf_dir):
    """Two-byte codes by ToUnicode maps."""
    key = F.struct("conv_id", "turn").alias("doc_id")
    made = pdfs(table(spark, sf_dir, "conversations").select(key, "text"), lambda t: build.unicode_pdf(t or ""))
    return pdf.page_text(made).select("doc_id.conv_id", "doc_id.turn", "text")


@query("SELECT page_id, url AS text FROM pages")
def text_roundtrip_objstm(spark, sf_dir):
    """Objects in object streams, cross-references in predicted streams."""
    made = pdfs(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url"), fixtures.packed_pdf)
    return pdf.page_text(made).select(F.col("doc_id").alias("page_id"), "text")


@query("SELECT p_partkey, p_name AS text FROM part")
def tj_spacing(spark, sf_dir):
    """Words that only kerning parts."""
    made = pdfs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_name"), lambda n: build.text_pdf([build.kerned_content(n.split(" "))]))
    return pdf.page_text(made).select(F.col("doc_id").alias("p_partkey"), "text")


def _tm(region: str, names: list[str]) -> bytes:
    lines = "\n".join(f"1 0 0 1 72 {700 - 20 * k} Tm ({n}) Tj" for k, n in enumerate(names))
    return build.text_pdf([f"BT /F1 9 Tf ({region}) Tj 14 TL ({names[0]}) ' 0 0 (x) \" T* (y) Tj 0 -3 TD (z) Tj\n{lines} ET BT (end) Tj ET".encode()])


@query("SELECT r_name, r_name || chr(10) || string_agg(n_name, chr(10) ORDER BY n_name).regexp_replace('^([^\n]*)', '\\1\nx\nyz\n\\1') || chr(10) || 'end' AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def text_operators(spark, sf_dir):
    """Every operator that moves or feeds lines; three units are no new line."""
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    rows = table(spark, sf_dir, "region").join(names, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("doc_id"), "r_name", "names")
    return pdf.page_text(pdfs(rows, _tm)).select(F.col("doc_id").alias("r_name"), "text")


@query("SELECT r_name, n_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def text_sorted(spark, sf_dir):
    """An extension: lines by place although the stream shows the lowest first."""
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    rows = table(spark, sf_dir, "region").join(names, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("doc_id"), "names")
    made = pdfs(rows, lambda names: build.text_pdf([("BT /F1 9 Tf " + " ".join(f"1 0 0 1 72 {100 + 20 * k} Tm ({n}) Tj" for k, n in enumerate(names)) + " ET").encode()]))
    lines = pdf.page_text(made, "sorted").select(F.col("doc_id").alias("r_name"), F.explode(F.split("text", "\n")).alias("text"))
    return lines


# -- structure


def _variant(k: int, words: str) -> bytes:
    made = fixtures.text_pdf(words)
    if k == 1:
        return made.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << /V 1 >>")
    if k == 2:
        return made.replace(b"%PDF-", b"%PDX-")
    if k == 3:
        return made.replace(b"startxref", b"startxxxx")
    if k == 4:
        return made + b"\n" * 8192
    return made.replace(b"trailer\n<<", b"trailer<<")


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 1 THEN 'encrypted' WHEN 2 THEN 'no PDF header' WHEN 3 THEN 'no cross-references' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 6 IN (1, 2, 3) THEN NULL ELSE 1 END::INTEGER AS n_pages FROM supplier")
def open_status(spark, sf_dir):
    """What opens and what does not, and why."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 6).cast("int").alias("k"), "s_name")
    return pdf.statuses(pdfs(rows, _variant)).select(F.col("doc_id").alias("s_suppkey"), "status", "n_pages")


def _orders_by_customer(spark, sf_dir) -> DataFrame:
    keys = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    return pdfs(keys, lambda keys: build.text_pdf([build.lines_content(str(k)) for k in keys], fanout=3))


@query("SELECT o_custkey, count(*) AS n_pages FROM orders GROUP BY o_custkey")
def page_count(spark, sf_dir):
    """Nested page trees."""
    return pdf.pages(_orders_by_customer(spark, sf_dir)).groupBy(F.col("doc_id").alias("o_custkey")).agg(F.count("*").alias("n_pages"))


@query("SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS page_index, o_orderkey::VARCHAR AS text FROM orders")
def page_order(spark, sf_dir):
    """Pages in tree order, with resources that they inherit."""
    return pdf.page_text(_orders_by_customer(spark, sf_dir)).withColumnRenamed("doc_id", "o_custkey")


@query("SELECT o_custkey, o_orderkey::VARCHAR AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k = 2")
def page_lookup(spark, sf_dir):
    """One page of each document, where there is one."""
    return pdf.page_text(_orders_by_customer(spark, sf_dir), page=2).select(F.col("doc_id").alias("o_custkey"), "text")


@query("SELECT n_regionkey AS doc_id, s_name AS name, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, s_suppkey) - 1)::INTEGER AS page_index, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS resources FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def pages_pretree(spark, sf_dir):
    """P1 P2 as a recursive query over tree rows: leaves in pre-order, resources of the nearest node that has some. A
    document for each region, a node for each nation, a page for each supplier."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    node = lambda doc, id, parent, ord, name, own, leaf: [F.col(doc).alias("doc_id"), id.alias("id"), parent.cast("string").alias("parent"), ord.cast("string").alias("ord"), F.col(name).alias("name"), own.cast("string").alias("own"), F.lit(leaf).alias("leaf")]
    none, number = F.lit(None), lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    rows = regions.select(*node("r_regionkey", F.lit("root"), none, F.lit("0"), "r_name", F.col("r_name"), False))
    rows = rows.union(nations.select(*node("n_regionkey", F.concat(F.lit("n"), "n_nationkey"), F.lit("root"), F.col("n_name"), "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), False)))
    rows = rows.union(suppliers.select(*node("n_regionkey", F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), number("s_suppkey"), "s_name", none, True)))
    return pdf.page_tree(rows).select("doc_id", "name", "page_index", "resources")


@query("SELECT s_suppkey, 5 + (s_suppkey % 3) AS n_objects, 6 + (s_suppkey % 3) AS next_object FROM supplier")
def xref_rows(spark, sf_dir):
    """Entries of cross-reference tables, as many as the file has objects, and the next free number."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 3).alias("k"))
    made = pdfs(rows, lambda k: build.classic({n: b"<< /Type /Catalog >>" if n == 1 else b"null" for n in range(1, 6 + k)}))
    counts = pdf.xref(made).where("kind = 'in_use'").groupBy("doc_id").agg(F.count("*").alias("n_objects"))
    return counts.join(pdf.statuses(made), "doc_id").select(F.col("doc_id").alias("s_suppkey"), "n_objects", "next_object")


@query("SELECT page_id, kind, n FROM pages, (VALUES ('compressed', 4), ('free', 1), ('in_use', 3)) AS t(kind, n)")
def xref_streams(spark, sf_dir):
    """Entries of cross-reference streams by kind."""
    made = pdfs(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url"), fixtures.packed_pdf)
    return pdf.xref(made).groupBy(F.col("doc_id").alias("page_id"), "kind").agg(F.count("*").cast("int").alias("n"))


def _hybrid(shown: str, older: str) -> bytes:
    """The table has the page, the stream that the trailer names its contents, and an older catalog that does not count."""
    page = b"<< /Type /Page /Contents 4 0 R >>"
    seen = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: page}
    return build.hybrid(seen, {4: build.flate_stream(build.lines_content(shown)), 5: build.flate_stream(build.lines_content(older))})


@query("SELECT s_suppkey, s_name AS text, 0.5::DOUBLE AS rev_rank FROM supplier")
def xref_hybrid(spark, sf_dir):
    """Contents that only the stream of a hybrid file has, which ranks below the table."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name", F.reverse("s_name").alias("older"))
    made = pdfs(rows, _hybrid)
    ranks = pdf.xref(made).where("obj_num = 4").select("doc_id", "rev_rank")
    return pdf.page_text(made).join(ranks, "doc_id").select(F.col("doc_id").alias("s_suppkey"), "text", "rev_rank")


@query("SELECT r_regionkey, CASE WHEN r_regionkey <= 2 THEN 'ok' ELSE 'no cross-references' END AS status FROM region")
def xref_budget(spark, sf_dir):
    """As many entries as a stream may have, and more."""
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), (F.col("r_regionkey") + 99_998).alias("n"))
    return pdf.statuses(pdfs(rows, build.many_entries)).select(F.col("doc_id").alias("r_regionkey"), "status")


@query("SELECT doc_id, substr(hex(encode(text)), 2 * (doc_id % 7) + 1, 2 * (doc_id % 90)) AS bytes FROM documents")
def byte_slices(spark, sf_dir):
    """Bytes from an offset on, fewer at the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return docs.select("doc_id", F.hex(slice_bytes(F.col("content"), (F.col("doc_id") % 7).cast("int"), (F.col("doc_id") % 90).cast("int"))).alias("bytes"))


@query(f"SELECT doc_id, 0 AS page_index, {_shown('lang || chr(10) || text')} AS text FROM documents")
def xref_revisions(spark, sf_dir):
    """An update that replaces the contents of a page hides the older object."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("\n", "lang", "text").alias("new"))
    return pdf.page_text(pdfs(rows, _revised))


def _revised(old: str | None, new: str) -> bytes:
    made = fixtures.text_pdf(old)
    start = int(made.rsplit(b"startxref", 1)[1].split()[0])
    out = made + b"101 0 obj\n" + build.flate_stream(build.lines_content(new)) + b"\nendobj\n"
    table_at = len(out)
    return out + f"xref\n101 1\n{len(made):010d} 00000 n \ntrailer\n<< /Size 102 /Root 1 0 R /Prev {start} >>\nstartxref\n{table_at}\n%%EOF\n".encode()


_EVENTS = "(SELECT event_id, (event_id % 500)::INTEGER AS obj_num, extract('hour' FROM ts)::INTEGER AS rev FROM events)"


@query(f"SELECT event_id, obj_num, rev FROM (SELECT *, rank() OVER (PARTITION BY obj_num ORDER BY rev) AS k FROM {_EVENTS}) WHERE k = 1")
def xref_merge(spark, sf_dir):
    """X7 as a relation: the newest revision of an object hides all older entries."""
    entries = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 500).cast("int").alias("obj_num"), F.hour("ts").alias("rev"))
    return pdf.merge_revisions(entries, ["obj_num"], "rev")


@query("SELECT o_custkey, CASE WHEN greatest(1, max(o_orderkey) + 1) + 3 <= 2147483647 THEN greatest(1, max(o_orderkey) + 1) END AS next_object FROM orders GROUP BY o_custkey")
def xref_next_object(spark, sf_dir):
    """X9 as a relation."""
    return pdf.next_object(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 3)


@query("SELECT doc_id, gen, min(o_orderkey) AS first, count(*) AS n FROM (SELECT (o_orderkey // 50)::BIGINT AS doc_id, o_orderkey, (o_custkey % 3)::INTEGER AS gen, o_orderkey - row_number() OVER (PARTITION BY o_orderkey // 50, o_custkey % 3 ORDER BY o_orderkey) AS island FROM orders) GROUP BY doc_id, gen, island")
def xref_sections(spark, sf_dir):
    """A8 as a relation: runs of numbers of one generation, document by document."""
    keys = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 50).alias("doc_id"), "o_orderkey", (F.col("o_custkey") % 3).cast("int").alias("gen"))
    return pdf.sections(keys, ["doc_id"], "o_orderkey", "gen").select("doc_id", "gen", "first", "n")


@query("SELECT s_suppkey, num::BIGINT AS obj_num, kind, type_name, serialized FROM supplier, LATERAL (VALUES (1, 'dictionary', 'Catalog', '<</Type /Catalog /Names [<' || hex(s_name) || '>]>>'), (2, 'array', NULL, '[' || s_suppkey || ' 0.25 true null 1 0 R]')) AS t(num, kind, type_name, serialized)")
def resolved_objects(spark, sf_dir):
    """Objects as they resolve, in text form."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_suppkey", "s_name")
    made = pdfs(rows, lambda k, n: build.classic({1: f"<< /Type /Catalog /Names [({n})] >>".encode(), 2: f"[{k} .25 true null 1 0 R]".encode()}))
    return pdf.objects(made).select(F.col("doc_id").alias("s_suppkey"), "obj_num", "kind", "type_name", "serialized")


@query("SELECT s_suppkey, key, kind, i, r, name FROM supplier, LATERAL (VALUES ('Type', 'name', NULL, NULL, 'Catalog'), ('Key', 'integer', s_suppkey, NULL, NULL), ('Half', 'real', NULL, s_suppkey / 2 + 0.25, NULL), ('Page', 'reference', NULL, NULL, NULL)) AS t(key, kind, i, r, name)")
def dictionary_entries(spark, sf_dir):
    """Dictionary entries with a column for each kind of value."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_suppkey")
    made = pdfs(rows, lambda k: build.classic({1: f"<< /Type /Catalog /Key {k} /Half {k / 2 + 0.25} /Page 1 0 R >>".encode()}))
    return pdf.dict_entries(made).select(F.col("doc_id").alias("s_suppkey"), "key", "kind", "i", "r", "name")


# -- outlines


_SECTIONS = "(SELECT r_name, n_name, row_number() OVER (ORDER BY r_name, n_name) - 1 AS page, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS s, dense_rank() OVER (ORDER BY r_name) AS c FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(
    f"""SELECT title, depth::INTEGER AS depth, page_index::INTEGER AS page_index, (row_number() OVER (ORDER BY c, s) - 1)::INTEGER AS entry_id
    FROM (SELECT n_name AS title, 2 AS depth, page AS page_index, c, s FROM {_SECTIONS} UNION ALL SELECT r_name, 1, min(page), c, 0 FROM {_SECTIONS} GROUP BY r_name, c)"""
)
def toc_flat(spark, sf_dir):
    """Chapters and sections in one outline, by destinations and by actions."""
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    chapters = table(spark, sf_dir, "region").join(names, F.col("r_regionkey") == F.col("n_regionkey")).agg(F.sort_array(F.collect_list(F.struct("r_name", "names"))).alias("chapters"))
    made = pdfs(chapters.select(F.lit(1).alias("doc_id"), "chapters"), lambda chapters: fixtures.outline_pdf([(c["r_name"], c["names"]) for c in chapters]))
    return pdf.toc(made).select("title", "depth", "page_index", "entry_id")


def _suppliers(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.sort_array(F.collect_list("s_name")).alias("names"))
    return pdfs(names, lambda names: fixtures.outline_pdf([("All", names)], "numbered"))  # suppliers may share a name


@query("SELECT s_nationkey, s_name AS title, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) - 1)::INTEGER AS page_index FROM supplier UNION ALL SELECT DISTINCT s_nationkey, 'All', 0 FROM supplier")
def toc_named_dest(spark, sf_dir):
    """Destinations by name through a name tree."""
    return pdf.toc(_suppliers(spark, sf_dir)).select(F.col("doc_id").alias("s_nationkey"), "title", "page_index")


@query("SELECT s_nationkey, s_name AS name, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) - 1)::INTEGER AS page_index FROM supplier")
def named_destinations(spark, sf_dir):
    """O8 O9 as a table."""
    return pdf.named_destinations(_suppliers(spark, sf_dir)).select(F.col("doc_id").alias("s_nationkey"), F.regexp_replace("name", "#[0-9]{9}$", "").alias("name"), "page_index")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN (l_quantity::INTEGER % 7) > 0 AND l_linenumber - 2 >= 0 THEN least(l_linenumber - 2, (l_quantity::INTEGER % 7) - 1) END::INTEGER AS page_index FROM lineitem")
def dest_clamp(spark, sf_dir):
    """O7."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geo.destination_page(F.col("l_linenumber") - 2, F.col("l_quantity").cast("int") % 7).cast("int").alias("page_index"))


# -- filters


_LENGTHS = "SELECT doc_id, octet_length(encode(coalesce(text, '')))::INTEGER AS n, md5(coalesce(text, '')) AS md5 FROM documents"


def _decoded(spark, sf_dir, names: list[str], encode, parms: dict | None = None, limit: int | None = None) -> DataFrame:
    kind = "array<struct<predictor: int, colors: int, columns: int, bits: int>>"
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = [None] * (len(names) - 1) + [parms] if parms else []
    streams = per_row(fixtures.spread(rows), lambda i, t: [(i, encode(t.encode()), names, own)], f"id long, raw binary, filters array<string>, parms {kind}")
    got = pdf.decode_streams(streams, limit)
    return got.select(F.col("id").alias("doc_id"), F.octet_length("data").alias("n"), F.md5("data").alias("md5"))


@query(_LENGTHS)
def filter_flate(spark, sf_dir):
    """F3 F5."""
    return _decoded(spark, sf_dir, ["FlateDecode"], zlib.compress)


@query(_LENGTHS)
def filter_a85(spark, sf_dir):
    """F11."""
    return _decoded(spark, sf_dir, ["A85"], lambda b: base64.a85encode(b, adobe=True))


@query(_LENGTHS)
def filter_hex(spark, sf_dir):
    """F10 in the kernel."""
    return _decoded(spark, sf_dir, ["ASCIIHexDecode"], lambda b: b.hex().encode() + b">")


@query(_LENGTHS)
def filter_hex_native(spark, sf_dir):
    """F10 as a column."""
    raw = F.coalesce("text", F.lit(""))
    data = text.ascii_hex(F.concat(F.hex(F.encode(raw, "UTF-8")), F.lit(" >zz")))
    return fixtures.spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.octet_length(data).alias("n"), F.md5(data).alias("md5"))


@query(_LENGTHS)
def filter_chain(spark, sf_dir):
    """Two filters in turn."""
    return _decoded(spark, sf_dir, ["ASCII85Decode", "Fl"], lambda b: base64.a85encode(zlib.compress(b)) + b"~>")


_PADDED = "SELECT doc_id, (8 * ceil(octet_length(encode(coalesce(text, ''))) / 8))::INTEGER AS n, md5(rpad(coalesce(text, ''), (length(coalesce(text, '')) + 8 * ceil(octet_length(encode(coalesce(text, ''))) / 8) - octet_length(encode(coalesce(text, ''))))::INTEGER, ' ')) AS md5 FROM documents"


@query(_PADDED)
def filter_png(spark, sf_dir):
    """Rows of eight bytes, filtered against the row above."""
    return _decoded(spark, sf_dir, ["Fl"], lambda b: zlib.compress(build.png_up(b + b" " * (-len(b) % 8), 8)), {"predictor": 12, "colors": 1, "columns": 8, "bits": 8}, 1 << 24)


def _differences(data: bytes) -> bytes:
    data += b" " * (-len(data) % 8)
    return zlib.compress(bytes((data[k] - (data[k - 2] if k % 8 >= 2 else 0)) & 255 for k in range(len(data))))


@query(_PADDED)
def filter_tiff(spark, sf_dir):
    """Rows of four samples of two components, as differences."""
    return _decoded(spark, sf_dir, ["Fl"], _differences, {"predictor": 2, "colors": 2, "columns": 4, "bits": 8})


@query("SELECT doc_id, CASE WHEN octet_length(encode(coalesce(text, ''))) <= 1000 THEN octet_length(encode(coalesce(text, '')))::INTEGER END AS n FROM documents")
def filter_limit(spark, sf_dir):
    """Nothing beyond a limit on the decoded bytes."""
    return _decoded(spark, sf_dir, ["Fl"], zlib.compress, limit=1000).select("doc_id", "n")


@query("SELECT doc_id, NULL::INTEGER AS n FROM documents")
def filter_unsupported(spark, sf_dir):
    """F12."""
    return _decoded(spark, sf_dir, ["LZWDecode"], lambda b: b).select("doc_id", "n")


# -- codes to text


@query("SELECT doc_id, text FROM documents")
def winansi_decode(spark, sf_dir):
    """Latin-1 bytes as WinAnsi. Line feeds are no characters of it, so lines are decoded one by one."""
    lines = F.transform(F.split("text", "\n"), lambda line: text.encoded_text(F.encode(line, "ISO-8859-1")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


@query("SELECT p_partkey, p_brand AS glyph, ord(p_brand)::INTEGER AS code FROM (SELECT p_partkey, unnest(string_split(regexp_replace(p_brand, '[^A-Za-z]', '', 'g'), '')) AS p_brand FROM part) UNION ALL SELECT p_partkey, 'uni' || lpad(hex(p_size), 4, '0'), p_size FROM part UNION ALL SELECT p_partkey, 'none', NULL FROM part UNION ALL SELECT p_partkey, 'quoteright', 8217 FROM part")
def glyph_names(spark, sf_dir):
    """Letters, names by number, names by the list, and unknown ones."""
    part = table(spark, sf_dir, "part")
    letters = part.select("p_partkey", F.explode(F.split(F.regexp_replace("p_brand", "[^A-Za-z]", ""), "")).alias("glyph")).where("glyph <> ''")
    numbers = part.select("p_partkey", F.concat(F.lit("uni"), F.lpad(F.hex("p_size"), 4, "0")).alias("glyph"))
    others = part.select("p_partkey", F.explode(F.array(F.lit("none"), F.lit("quoteright"))).alias("glyph"))
    return letters.union(numbers).union(others).withColumn("code", text.glyph_code(F.col("glyph")))


def _shifted(brand: str) -> bytes:
    """A font whose codes 1, 2, ... are given names by Differences."""
    chars = sorted(set(brand))
    names = {"#": "numbersign", " ": "space"}
    listed = " ".join("/" + names.get(c, c) for c in chars)
    font = f"<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /MacRomanEncoding /Differences [1 {listed}] >> >>".encode()
    shown = "".join(f"{chars.index(c) + 1:02X}" for c in brand)
    return build.text_pdf([f"BT /F1 12 Tf <{shown}> Tj ET".encode()], {3: font})


@query("SELECT p_partkey, p_brand AS text FROM part")
def font_differences(spark, sf_dir):
    """Codes by glyph names."""
    made = pdfs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_brand"), _shifted)
    return pdf.page_text(made).select(F.col("doc_id").alias("p_partkey"), "text")


def _ranges(size: int) -> bytes:
    body = f"begincmap 1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfrange <01> <{size:02X}> <0041> <F0> <F2> [<0061> <00620063> <D83DDE00>] endbfrange 1 beginbfchar <F5> <20AC> endbfchar"
    return build.text_pdf([b"BT /F1 12 Tf (x) Tj ET"], {3: b"<< /Type /Font /Subtype /Type1 /ToUnicode 4 0 R >>", 4: build.flate_stream(body.encode())})


@query("SELECT p_partkey, code::INTEGER AS code, target FROM (SELECT p_partkey, unnest(range(1, p_size + 1)) AS code, chr((64 + code)::INTEGER) AS target FROM part) UNION ALL SELECT p_partkey, code, target FROM part, (VALUES (240, 'a'), (241, 'bc'), (242, chr(128512)), (245, '€')) AS t(code, target)")
def cmap_codes(spark, sf_dir):
    """Ranges, arrays and single codes of ToUnicode maps."""
    made = pdfs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), "p_size"), _ranges)
    return pdf.cmaps(made).select(F.col("doc_id").alias("p_partkey"), "code", "target")


@query("SELECT n_nationkey, n_name AS be, n_name AS le, n_name AS latin FROM nation")
def pdf_text_string(spark, sf_dir):
    """U13."""
    name = F.col("n_name")
    marked = lambda mark, charset: F.concat(F.unhex(F.lit(mark)), F.encode(name, charset))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.text_string(marked("FEFF", "UTF-16BE")).alias("be"), text.text_string(marked("FFFE", "UTF-16LE")).alias("le"), text.text_string(F.encode(name, "ISO-8859-1")).alias("latin"))


# -- rendering


_W = "((l_orderkey * 7 + l_linenumber * 131) % 3000 - 100)::INTEGER"
_BUCKET = "CASE WHEN greatest({0}, 1) <= 220 THEN 220 WHEN {0} <= 720 THEN 720 WHEN {0} <= 1080 THEN 1080 WHEN {0} <= 1440 THEN 1440 WHEN {0} <= 1800 THEN 1800 ELSE 2200 END"


def _lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("w", ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 131) % 3000 - 100).cast("int"))


_ASKED = f"least(greatest(floor(({_W}::FLOAT * 1.25::FLOAT)::DOUBLE + 0.5), 360), 2200)"
_STEPS = f"least(greatest(floor(({_ASKED} + 63) / 128) * 128, 720), 2200)"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN {_W} > 0 THEN {_BUCKET.format(_STEPS)} END::INTEGER AS width FROM lineitem")
def target_width(spark, sf_dir):
    """V1."""
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", render.target_width(F.col("w")).alias("width"))


@query(f"SELECT l_orderkey, l_linenumber, ({_BUCKET.format(_W)})::INTEGER AS width FROM lineitem")
def bucket_width(spark, sf_dir):
    """V4."""
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", render.bucket_width(F.col("w")).alias("width"))


_FALL = ", ".join(f"greatest(floor((w::FLOAT * {f}::FLOAT)::DOUBLE + 0.5), 360)::INTEGER" for f in render.FALLBACKS)


@query(f"SELECT l_orderkey, l_linenumber, width FROM (SELECT l_orderkey, l_linenumber, w, unnest(list_distinct([w, {_FALL}, 360])) AS width FROM (SELECT l_orderkey, l_linenumber, greatest({_W}, 1) AS w FROM lineitem)) WHERE width <= w")
def fallback_widths(spark, sf_dir):
    """V2."""
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.explode(render.fallback_widths(F.col("w"))).alias("width"))


_PAGE = "(SELECT l_orderkey, l_linenumber, (l_partkey % 5000 + 1)::DOUBLE AS pw, (l_suppkey % 700 * 13 + 1)::DOUBLE AS ph, {w} AS w FROM lineitem)".format(w=_W)
_SAFE = f"(SELECT l_orderkey, l_linenumber, ph / pw AS a, least(least(greatest(w, 1), 4096), greatest(floor(sqrt(8000000.0 / (ph / pw))), 1), greatest(floor(4096.0 / (ph / pw)), 1)) AS w0 FROM {_PAGE})"
_SAFE = f"(SELECT l_orderkey, l_linenumber, a, CASE WHEN w0 > 1 AND w0 * greatest(floor(w0 * a + 0.5), 1) > 8000000 THEN w0 - 1 ELSE w0 END AS w FROM {_SAFE})"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN w END::INTEGER AS width, CASE WHEN ok THEN h END::INTEGER AS height FROM (SELECT *, h <= 4096 AND w * h <= 8000000 AS ok FROM (SELECT *, greatest(floor(w * a + 0.5), 1) AS h FROM {_SAFE}))")
def safe_dims(spark, sf_dir):
    """V3."""
    size = render.safe_dimensions(F.col("w"), (F.col("l_partkey") % 5000 + 1).cast("int"), (F.col("l_suppkey") % 700 * 13 + 1).cast("int"))
    return _lines(spark, sf_dir).withColumn("s", size).select("l_orderkey", "l_linenumber", F.col("s.width").alias("width"), F.col("s.height").alias("height"))


@query(f"SELECT l_orderkey, l_linenumber, {_W} > 0 AND l_partkey % 900 > 0 AND {_W} >= greatest(least(l_partkey % 900, 360), 1) AS ok FROM lineitem")
def bitmap_ok(spark, sf_dir):
    """V5."""
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", render.bitmap_acceptable(F.col("w"), (F.col("l_partkey") % 900)).alias("ok"))


_TILE = "(SELECT l_orderkey, l_linenumber, least(greatest(x, 0), 120) AS x, least(greatest(y, 0), 160) AS y, least(greatest(x + tw, least(greatest(x, 0), 120)), 120) AS r, least(greatest(y + th, least(greatest(y, 0), 160)), 160) AS b, tw, th FROM (SELECT l_orderkey, l_linenumber, l_partkey % 300 - 100 AS x, l_suppkey % 300 - 100 AS y, (l_quantity::INTEGER * 3 - 9) AS tw, (l_quantity::INTEGER * 2) AS th FROM lineitem))"


@query(f"SELECT l_orderkey, l_linenumber, x::INTEGER AS x, y::INTEGER AS y, (r - x)::INTEGER AS width, (b - y)::INTEGER AS height FROM {_TILE} WHERE tw > 0 AND th > 0 AND r > x AND b > y")
def clamp_tile(spark, sf_dir):
    """V6."""
    q = F.col("l_quantity").cast("int")
    tile = render.clamp_tile(F.col("l_partkey") % 300 - 100, F.col("l_suppkey") % 300 - 100, q * 3 - 9, q * 2, F.lit(120), F.lit(160))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tile.alias("t")).where("t is not null").select("l_orderkey", "l_linenumber", "t.x", "t.y", "t.width", "t.height")


_REASON = "CASE event_id % 6 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in enumerate(render.REASONS)) + " ELSE 'OTHER' END"


@query(f"SELECT event_id, CASE WHEN event_id % 6 < 5 THEN event_id % 6 END::INTEGER AS priority FROM (SELECT event_id, {_REASON} AS reason FROM events)")
def reason_priority(spark, sf_dir):
    """V8."""
    reason = F.element_at(F.array(*(F.lit(r) for r in (*render.REASONS, "OTHER"))), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", render.reason_priority(reason).alias("priority"))


@query("SELECT (user_id % 20)::INTEGER AS page, (event_id % 3)::INTEGER AS target_width, min(event_id % 5)::INTEGER AS priority, max(event_id) AS generation FROM events GROUP BY user_id % 20, event_id % 3")
def request_key_dedup(spark, sf_dir):
    """V7: requests by page, width and tile."""
    reason = F.element_at(F.array(*(F.lit(r) for r in render.REASONS)), (F.col("event_id") % 5 + 1).cast("int"))
    tile = F.lit(None).cast("struct<x: int, y: int, width: int, height: int>")
    asked = table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("int").alias("page"), (F.col("event_id") % 3).cast("int").alias("target_width"), F.col("event_id").alias("generation"), render.reason_priority(reason).alias("priority"), tile.alias("tile"))
    return selection.dedup_requests(asked).select("page", "target_width", "priority", "generation")


@query("SELECT (user_id % 20)::INTEGER AS page, count(*) AS renders, count(*) FILTER (event_id % 6 = 0) AS successes, count(*) FILTER (event_id % 2 = 0) AS cache_hits, count(*) FILTER (event_id % 3 = 0) AS fallbacks, max(event_id % 1000) AS slowest_ms, sum(event_id % 1000)::BIGINT AS total_ms FROM events GROUP BY user_id % 20")
def telemetry_summary(spark, sf_dir):
    """V9 S9, summed up (an extension)."""
    e = F.col("event_id")
    result = F.element_at(F.array(*(F.lit(r) for r in selection.RESULTS)), (e % 6 + 1).cast("int"))
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 20).cast("int").alias("page"), result.alias("result"), (e % 2 == 0).alias("cache_hit"), (e % 3 == 0).alias("used_fallback_width"), (e % 1000).alias("total_ms"))
    return selection.telemetry_summary(events)


@query("SELECT event_id, (user_id % 20)::INTEGER AS page, event_id % 1000 AS total_ms FROM events")
def telemetry_recorded(spark, sf_dir):
    """Events as the sink has written them, read back; without a table it takes them and writes nothing."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared}/telemetry-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 20).cast("int").alias("page"), (F.col("event_id") % 1000).alias("total_ms"))
    record_telemetry(events, None)
    record_telemetry(events, folder)
    return spark.read.schema(events.schema).parquet(folder)


# -- geometry


_RECT = "(SELECT l_orderkey, l_linenumber, (l_partkey % 500)::FLOAT AS l, (l_suppkey % 90)::FLOAT AS t, (l_quantity * 8)::FLOAT AS r, (l_discount * 1000)::FLOAT AS b FROM lineitem)"


def _rects(spark, sf_dir) -> DataFrame:
    r = geo.rect(F.col("l_partkey") % 500, F.col("l_suppkey") % 90, F.col("l_quantity") * 8, F.col("l_discount") * 1000)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("rect"))


def _sides(r: str, *keys: str) -> list:
    return [*keys, *(F.col(f"{r}.{side}").cast("double").alias(side) for side in ("left", "top", "right", "bottom"))]


@query(f"SELECT l_orderkey, l_linenumber, least(l, r)::DOUBLE AS \"left\", least(t, b)::DOUBLE AS top, greatest(l, r)::DOUBLE AS \"right\", greatest(t, b)::DOUBLE AS bottom, l <> r AND t <> b AS usable FROM {_RECT}")
def rect_normalize(spark, sf_dir):
    """G5 A10."""
    return _rects(spark, sf_dir).withColumn("n", geo.normalized(F.col("rect"))).select(*_sides("n", "l_orderkey", "l_linenumber"), geo.usable(F.col("n")).alias("usable"))


@query(f"SELECT l_orderkey, min(least(l, r))::DOUBLE AS \"left\", min(least(t, b))::DOUBLE AS top, max(greatest(l, r))::DOUBLE AS \"right\", max(greatest(t, b))::DOUBLE AS bottom FROM {_RECT} WHERE l <> r AND t <> b GROUP BY l_orderkey")
def highlight_union(spark, sf_dir):
    """A5: the box around the usable rectangles of a highlight."""
    lists = _rects(spark, sf_dir).groupBy("l_orderkey").agg(geo.usable_rects(F.collect_list("rect")).alias("rects"))
    return lists.withColumn("u", geo.union(F.col("rects"))).where("u is not null").select(*_sides("u", "l_orderkey"))


_QUADS = "[least(l, r), 792 - least(t, b), greatest(l, r), 792 - least(t, b), least(l, r), 792 - greatest(t, b), greatest(l, r), 792 - greatest(t, b)]"


@query(f"SELECT l_orderkey, l_linenumber, unnest(range(8))::INTEGER AS k, unnest({_QUADS})::FLOAT::DOUBLE AS v FROM {_RECT}")
def quad_points(spark, sf_dir):
    """Corners of rectangles, from the page's foot."""
    page = geo.page_height(F.array(F.lit(0.0), F.lit(0.0), F.lit(612.0), F.lit(792.0)))
    points = geo.quad_points(F.array(geo.normalized(F.col("rect"))), page)
    return _rects(spark, sf_dir).select("l_orderkey", "l_linenumber", F.posexplode(points).alias("k", "v")).withColumn("v", F.col("v").cast("double"))


_WORD = f"""(SELECT *, least(greatest(sr, s + least_w, s + 1::FLOAT), rt)::FLOAT AS e FROM (
  SELECT *, least(greatest(least(sl, sr - 1::FLOAT), lt), greatest(rt - least_w, lt))::FLOAT AS s FROM (
    SELECT *, greatest(least(18::FLOAT, wide), 1::FLOAT) AS least_w FROM (
      SELECT l_orderkey, l_linenumber, least(l, r) AS lt, least(t, b) AS tp, greatest(l, r) AS rt, greatest(t, b) AS bt, (l + 5)::FLOAT AS sl, (l + 40)::FLOAT AS sr, (t + 20)::FLOAT AS py,
        greatest(greatest(l, r) - least(l, r), 1::FLOAT) AS wide, greatest(greatest(t, b) - least(t, b), 1::FLOAT) AS tall FROM {_RECT}))))"""
_WORD = f"(SELECT *, least(greatest(8::FLOAT, least(20::FLOAT, greatest(e - s, 1::FLOAT) * 0.45::FLOAT, tall * 0.42::FLOAT)), tall)::FLOAT AS nat FROM {_WORD})"
_WORD = f"(SELECT *, least(greatest((least(greatest(py, tp), bt) - nat / 2::FLOAT)::FLOAT, tp), bt - nat)::FLOAT AS y, tall > 18 AND tall > nat * 1.15::FLOAT AS tight FROM {_WORD})"


@query(f"SELECT l_orderkey, l_linenumber, s::DOUBLE AS \"left\", (CASE WHEN tight THEN y ELSE tp END)::DOUBLE AS top, e::DOUBLE AS \"right\", (CASE WHEN tight THEN y + nat ELSE bt END)::FLOAT::DOUBLE AS bottom FROM {_WORD} WHERE s + 1::FLOAT <= rt")
def word_rect(spark, sf_dir):
    """G4."""
    r = F.col("rect")
    words = _rects(spark, sf_dir).select("l_orderkey", "l_linenumber", r.alias("fragment"), (r["left"] + geo.f32(5)).alias("left"), (r["left"] + geo.f32(40)).alias("right"), (r["top"] + geo.f32(20)).alias("press_y"))
    return selection.word_rects(words).where("word is not null").select(*_sides("word", "l_orderkey", "l_linenumber"))


_BODY = r"regexp_full_match(ch, '[\p{L}\p{Nd}\p{Nl}\p{M}]')"


@query(
    f"""WITH c AS (SELECT doc_id, doc_id * 7 % 500 AS o, length(text) AS len, unnest(range(1, length(text) + 1)) AS i, unnest(string_split(text, '')) AS ch FROM documents),
    b AS (SELECT *, {_BODY} AS body FROM c),
    m AS (SELECT *, body OR (ch IN ('''', '’', '-', '_') AND lag(body, 1, false) OVER w AND lead(body, 1, false) OVER w) AS inside FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    r AS (SELECT doc_id, least(any_value(o), any_value(len)) AS o, min(i) - 1 AS a, max(i) AS z, string_agg(ch, '' ORDER BY i) AS word FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM m WHERE inside) GROUP BY doc_id, g),
    n AS (SELECT *, greatest(a - o, o - z, 0) AS d, row_number() OVER (PARTITION BY doc_id ORDER BY greatest(a - o, o - z, 0), a) AS k FROM r)
    SELECT documents.doc_id, a::INTEGER AS start, z::INTEGER AS "end", word FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id AND k = 1 AND d <= 3"""
)
def word_at_offset(spark, sf_dir):
    """G1-G3."""
    probes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", (F.col("doc_id") * 7 % 500).cast("int").alias("offset"))
    return selection.words_at(probes).withColumnRenamed("id", "doc_id")


# -- syntax


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(x) < 0.0001 THEN '0' WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.4f', x), '0'), '.') END AS s FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount / 7 - 100 * l_tax AS x FROM lineitem)")
def pdf_number(spark, sf_dir):
    """H3."""
    x = F.col("l_extendedprice") * F.col("l_discount") / 7 - 100 * F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.pdf_number(x).alias("s"))


@query(r"SELECT doc_id, replace(replace(replace(replace(replace(replace(text, '\', '\\'), '(', '\('), ')', '\)'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') AS s FROM documents")
def escape_literal(spark, sf_dir):
    """H4."""
    return table(spark, sf_dir, "documents").select("doc_id", text.escape_literal(F.col("text")).alias("s"))


@query(
    """SELECT e.event_id, p.s FROM events AS e JOIN (SELECT event_type, string_agg(CASE WHEN regexp_full_match(ch, '[!-~]') AND ch NOT IN ('#', '/', '%', '(', ')', '<', '>', '[', ']', '{', '}') THEN ch ELSE '#' || lpad(hex(ord(ch)), 2, '0') END, '' ORDER BY i) AS s
    FROM (SELECT event_type, unnest(string_split(event_type || ' (#1)/é' || chr(10), '')) AS ch, unnest(range(length(event_type || ' (#1)/é' || chr(10)))) AS i FROM (SELECT DISTINCT event_type FROM events)) GROUP BY event_type) AS p USING (event_type)"""
)
def escape_name(spark, sf_dir):
    """H5."""
    return table(spark, sf_dir, "events").select("event_id", text.escape_name(F.concat("event_type", F.lit(" (#1)/é\n"))).alias("s"))


# -- writing


def _noted(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = pdfs(docs.select("doc_id", "text"), fixtures.text_pdf)
    rects = F.array(geo.rect(10, 10, 110, 30), geo.rect(110, 30, 10, 60), geo.rect(5, 5, 5, 9))
    none = F.lit(None).cast(f"array<{geo.RECT}>")
    both = F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("highlight").alias("kind"), rects.alias("rects"), F.lit(0.0).cast("float").alias("x"), F.concat(F.lit(" "), "lang").alias("contents")),
        F.struct(F.lit(2).alias("seq"), F.lit("note").alias("kind"), none.alias("rects"), F.lit(50.5).cast("float").alias("x"), F.col("source").alias("contents")),
    )
    notes = docs.select("doc_id", F.explode(both).alias("n")).select("doc_id", "n.*", F.lit(0).alias("page_index"), F.lit(70.0).cast("float").alias("y"), *(F.lit(v).cast("float").alias(c) for c, v in (("red", 1.5), ("green", 0.5), ("blue", -1.0))))
    return pdf.annotate(made, notes)


@query(f"SELECT doc_id, {_shown('text')} AS text FROM documents")
def annotate_reread(spark, sf_dir):
    """The text of documents after notes were appended."""
    return pdf.page_text(_noted(spark, sf_dir)).select("doc_id", "text")


@query("SELECT doc_id, ord::INTEGER AS ord, subtype, contents, rect FROM (SELECT doc_id, 0 AS ord, 'Highlight' AS subtype, lang AS contents, '[10 732 110 782]' AS rect FROM documents UNION ALL SELECT doc_id, 1, 'Text', source, '[50.5 700 72.5 722]' FROM documents)")
def annotations_listed(spark, sf_dir):
    """The notes as the pages list them."""
    return pdf.annotations(_noted(spark, sf_dir)).select("doc_id", "ord", "subtype", "contents", "rect")


_BRANDS = "SELECT p_brand, 1 AS page_index, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS ord, p_name AS block FROM part"


def _brands(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("doc_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"]).alias("names"))
    return pdfs(names, fixtures.blocks_pdf)


@query(_BRANDS)
def ai_blocks(spark, sf_dir):
    """Private blocks by number, as strings and as streams."""
    return pdf.private_blocks(_brands(spark, sf_dir)).select(F.col("doc_id").alias("p_brand"), "page_index", "ord", F.decode("bytes", "UTF-8").alias("block"))


@query(_BRANDS)
def ai_first_blocks(spark, sf_dir):
    """The blocks of the first page that has some."""
    return pdf.first_private_blocks(_brands(spark, sf_dir)).select(F.col("doc_id").alias("p_brand"), "page_index", "ord", F.decode("bytes", "UTF-8").alias("block"))


@query("SELECT p_brand, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1)::INTEGER AS ord, p_name AS block FROM part")
def ai_blocks_of_page(spark, sf_dir):
    """The blocks of one page of each document, by a column of it; the other page is not read."""
    made = _brands(spark, sf_dir).withColumn("wanted", F.lit(1))
    return pdf.private_blocks(made, F.col("wanted")).select(F.col("doc_id").alias("p_brand"), "ord", F.decode("bytes", "UTF-8").alias("block"))


@query("SELECT s_suppkey, 3::BIGINT AS n_operators, 1::BIGINT AS n_shown FROM supplier")
def text_ops(spark, sf_dir):
    """Operators of contents, as a table."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), "s_name")
    made = pdfs(rows, lambda n: build.text_pdf([f"/F1 9 Tf [({n}) [1 2] << /a 1 >>] TJ ] q".encode()]))
    return pdf.text_ops(made).groupBy(F.col("doc_id").alias("s_suppkey")).agg(F.count("*").alias("n_operators"), F.sum((F.col("operator") == "TJ").cast("long")).alias("n_shown"))

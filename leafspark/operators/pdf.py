"""Documents to tables. A document that cannot be read gives no rows but one in statuses(); whatever goes wrong in one, the
others are read."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafspark.functions.text import looks_like_pdf
from leafspark.kernels import annotate as annotation
from leafspark.kernels import blocks as private
from leafspark.kernels import content, filters, outline
from leafspark.kernels.document import Document, open_document, type_of
from leafspark.kernels.fonts import Fonts
from leafspark.kernels.objects import NULL, Name, PdfError, Ref, number, serialize
from leafspark.operators.kernel import per_row

NOTE = (
    "struct<seq: int, kind: string, page_index: int, rects: array<struct<left: float, top: float, right: float, bottom: float>>, "
    "x: float, y: float, red: float, green: float, blue: float, contents: string>"
)


def opened(data: bytes | None) -> Document | None:
    try:
        return open_document(data) if data else None
    except Exception:  # noqa: BLE001 - one file's bytes must not end the job of all
        return None


def _soft(kernel):
    """What kernel(document) gives for a document that opens; nothing where reading on fails."""

    def run(doc_id, data, *more):
        document = opened(data)
        if document is None:
            return []
        try:
            return [(doc_id, *row) for row in kernel(document, *more)]
        except Exception:  # noqa: BLE001
            return []

    return run


def _of(docs: DataFrame, kernel, columns: str, *more: Column) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    # What has no header is turned away before its bytes go to Python.
    return per_row(docs.where(looks_like_pdf(F.col("content"))).select("doc_id", "content", *more), _soft(kernel), f"doc_id {kind}, {columns}")


def _page_by_page(docs: DataFrame, read, columns: str, page: int | Column | None) -> DataFrame:
    """read(document, page, index) for all pages, or for the one of an index (a number, or a column of docs) alone."""

    every = page is None  # a column cannot go to the executors

    def run(document, only=None):
        found = document.pages()
        for k in range(len(found)) if every else [only] if only is not None and 0 <= only < len(found) else []:
            yield from read(document, found[k], k)

    asked = [] if page is None else [(page if isinstance(page, Column) else F.lit(page)).cast("long").alias("_page")]
    return _of(docs, run, columns, *asked)


def statuses(docs: DataFrame) -> DataFrame:
    """doc_id, status ("ok" or what is wrong), n_pages, start_xref, next_object, one row for each document."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(doc_id, data):
        try:
            document = open_document(data or b"")
            return [(doc_id, "ok", len(document.pages()), document.start, document.next_number(1))]
        except Exception as e:  # noqa: BLE001
            return [(doc_id, (str(e) if isinstance(e, PdfError) else f"{type(e).__name__}: {e}")[:200], None, None, None)]

    return per_row(docs.select("doc_id", "content"), run, f"doc_id {kind}, status string, n_pages int, start_xref long, next_object long")


def xref(docs: DataFrame) -> DataFrame:
    """Cross-reference entries that hold, one row each; rev_rank 0 is the newest section."""

    def run(document):
        for (num, gen), e in (*document.entries.items(), *document.packed.items()):
            of = lambda kind, value, e=e: value if e.kind == kind else None
            yield num, gen, e.kind, of("in_use", e.a), of("free", e.a), of("compressed", e.a), of("compressed", e.b), e.rank

    return _of(docs, run, "obj_num long, gen int, kind string, offset long, next_free long, objstm_num long, objstm_idx int, rev_rank double")


def merge_revisions(entries: DataFrame, keys: list[str], rank: str = "rev_rank") -> DataFrame:
    """Of entries from several revisions, those of each object's newest one (least rank; ties stay)."""
    newest = F.min(rank).over(Window.partitionBy(*keys))
    return entries.withColumn("_newest", newest).where(F.col(rank) == F.col("_newest")).drop("_newest")


def next_object(entries: DataFrame, group: str, num: str, count: int = 1) -> DataFrame:
    """The first of count unused object numbers of each group; null where there are not so many."""
    first = F.greatest(F.lit(1).cast("long"), F.max(num).cast("long") + 1)
    return entries.groupBy(group).agg(first.alias("_n")).select(group, F.when(F.col("_n") + count <= 2**31 - 1, F.col("_n")).alias("next_object"))


def page_tree(nodes: DataFrame) -> DataFrame:
    """Pages of page trees given as rows: nodes(doc_id, id, parent, ord, name, own, leaf), where roots have no parent.
    doc_id, page_index, name, resources of the leaves in pre-order; resources are those (own) of the nearest node that
    has some. A node below itself is not walked again. Documents are numbered side by side. The session's limits on
    recursive queries (a million rows, a hundred levels) are lifted: each row here is walked once."""
    for limit, value in (("Row", -1), ("Level", 1 << 20)):
        nodes.sparkSession.conf.set(f"spark.sql.cteRecursion{limit}Limit", str(value))
    walked = nodes.sparkSession.sql(
        """
        WITH RECURSIVE walk(doc_id, id, name, leaf, resources, path, seen) AS (
          SELECT doc_id, id, name, leaf, own, array(ord), array(id) FROM {nodes} WHERE parent IS NULL
          UNION ALL
          SELECT t.doc_id, t.id, t.name, t.leaf, coalesce(t.own, w.resources), concat(w.path, array(t.ord)), concat(w.seen, array(t.id))
          FROM walk AS w JOIN {nodes} AS t ON t.doc_id = w.doc_id AND t.parent = w.id WHERE NOT array_contains(w.seen, t.id)
        )
        SELECT doc_id, name, resources, path FROM walk WHERE leaf
        """,
        nodes=nodes,
    )
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return walked.select("doc_id", index.cast("int").alias("page_index"), "name", "resources")


def sections(entries: DataFrame, group: list[str], num: str, gen: str) -> DataFrame:
    """Runs of neighbouring object numbers of one generation: first number and count."""
    island = F.col(num) - F.row_number().over(Window.partitionBy(*group, gen).orderBy(num))
    return entries.withColumn("_island", island).groupBy(*group, gen, "_island").agg(F.min(num).alias("first"), F.count("*").alias("n")).drop("_island")


def _kind(value) -> str:
    for kind, test in (("null", value is NULL), ("boolean", isinstance(value, bool)), ("integer", isinstance(value, int)), ("real", isinstance(value, float)), ("name", isinstance(value, Name)), ("string", isinstance(value, bytes)), ("reference", isinstance(value, Ref)), ("array", isinstance(value, list))):
        if test:
            return kind
    return "dictionary"


def _resolved(document):
    for num, gen in sorted({*document.entries, *document.packed}):
        value = document.resolve(Ref(num, gen))
        if value is not None:
            yield num, gen, value


def objects(docs: DataFrame) -> DataFrame:
    """Every object that resolves, in its text form."""

    def run(document):
        for num, gen, value in _resolved(document):
            own = value if isinstance(value, dict) else {}
            yield num, gen, _kind(value), type_of(own, "Type"), type_of(own, "Subtype"), serialize(value)

    return _of(docs, run, "obj_num long, gen int, kind string, type_name string, subtype string, serialized string")


def dict_entries(docs: DataFrame) -> DataFrame:
    """The entries of every dictionary object, in a column for each kind of value."""

    def run(document):
        for num, gen, value in _resolved(document):
            for order, (key, v) in enumerate(value.items() if isinstance(value, dict) else ()):
                kind, ref = _kind(v), v if isinstance(v, Ref) else (None, None)
                of = lambda k, x, kind=kind: x if kind == k else None
                yield num, gen, key, order, kind, of("integer", v), of("real", v), of("name", v), of("string", v), ref[0], ref[1]

    return _of(docs, run, "obj_num long, gen int, key string, ord int, kind string, i long, r double, name string, bytes binary, ref_num long, ref_gen int")


def pages(docs: DataFrame) -> DataFrame:
    """The pages in order, without reading their contents."""

    def run(document):
        for k, p in enumerate(document.pages()):
            found = p.dictionary.get("Contents")
            refs = [found] if isinstance(found, Ref) else [r for r in found if isinstance(r, Ref)] if isinstance(found, list) else []
            box = p.dictionary.get("MediaBox")
            sides = [number(v) for v in box] if isinstance(box, list) else None
            yield k, *(p.ref or (None, None)), [{"num": r.num, "gen": r.gen} for r in refs], None if p.resources is None else serialize(p.resources), None if sides is None else [None if s is None else float(s) for s in sides]

    return _of(docs, run, "page_index int, obj_num long, gen int, contents array<struct<num: long, gen: int>>, resources string, media_box array<double>")


def page_streams(docs: DataFrame) -> DataFrame:
    """Decoded contents of every page; null where a piece fails."""

    def run(document):
        for k, p in enumerate(document.pages()):
            try:
                yield k, document.contents(p)
            except PdfError:
                yield k, None

    return _of(docs, run, "page_index int, data binary")


def fonts(docs: DataFrame) -> DataFrame:
    """The fonts that each page's resources name."""

    def run(document):
        for k, p in enumerate(document.pages()):
            listed = Fonts(document, p.resources)
            for key in listed.listed:
                f = listed.get(key)
                if f:
                    yield k, key, f.width, f.cmap is not None, len(f.cmap.single.all()) + len(f.cmap.double.all()) if f.cmap else 0, len(f.differences)

    return _of(docs, run, "page_index int, name string, code_width int, to_unicode boolean, n_mapped int, n_differences int")


def cmaps(docs: DataFrame) -> DataFrame:
    """The codes that each font's ToUnicode map has: one row for each."""

    def run(document):
        for k, p in enumerate(document.pages()):
            listed = Fonts(document, p.resources)
            for key in listed.listed:
                f = listed.get(key)
                for width, codes in ((1, f.cmap.single), (2, f.cmap.double)) if f and f.cmap else ():
                    for code, target in codes.all().items():
                        yield k, key, width, code, content.whole(target)

    return _of(docs, run, "page_index int, name string, width int, code int, target string")


def text_ops(docs: DataFrame) -> DataFrame:
    """Content operators in order with their operands in text form."""

    def run(document):
        for k, p in enumerate(document.pages()):
            seq = 0
            try:
                for operator, operands in content.operations(document.contents(p) or b""):
                    yield k, seq, operator, [serialize(o) for o in operands]
                    seq += 1
            except PdfError:
                pass

    return _of(docs, run, "page_index int, seq int, operator string, operands array<string>")


def page_text(docs: DataFrame, order: str = "stream", page: int | Column | None = None) -> DataFrame:
    """doc_id, page_index, text of every page: in stream order, or (an extension) in order "sorted" by place. With page, a
    number or a column of docs, only that page is decoded; documents without it give no row."""
    reader = {"stream": content.page_text, "sorted": content.sorted_text}[order]
    return _page_by_page(docs, lambda d, p, k: [(k, reader(d, p))], "page_index int, text string", page)


def toc(docs: DataFrame) -> DataFrame:
    """Entries of tables of contents, flat: parent and path give the tree."""
    return _of(docs, lambda d: outline.rows(outline.Outline(d).items()), "entry_id int, parent_id int, depth int, path array<int>, title string, page_index int")


def toc_json(docs: DataFrame) -> DataFrame:
    """Tables of contents as one JSON tree for each document."""

    def tree(items):
        return [{"title": i.title, "pageIndex": i.page, "children": tree(i.children)} for i in items]

    return _of(docs, lambda d: [(json.dumps(tree(outline.Outline(d).items()), ensure_ascii=False),)], "toc string")


def named_destinations(docs: DataFrame) -> DataFrame:
    """Named destinations with the pages that they lead to."""

    def run(document):
        found = outline.Outline(document)
        for order, (key, value) in enumerate(found.named().items()):
            yield key, order, found.destination(value, {key})

    return _of(docs, run, "name string, ord int, page_index int")


def private_blocks(docs: DataFrame, page: int | Column | None = None) -> DataFrame:
    """Illustrator's private blocks of all pages, or of one, by number."""
    return _page_by_page(docs, lambda d, p, k: [(k, i, n, b) for i, (n, b) in enumerate(private.page_blocks(d, p))], "page_index int, ord int, number long, bytes binary", page)


def first_private_blocks(docs: DataFrame) -> DataFrame:
    """The blocks of the first page of each document that has any; later pages are not read."""

    def run(document):
        found = private.first_blocks(document)
        return [(found[0], i, n, b) for i, (n, b) in enumerate(found[1])] if found else []

    return _of(docs, run, "page_index int, ord int, number long, bytes binary")


def annotate(docs: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, content with the notes (doc_id and the fields of NOTE) of each document appended, in order of seq.
    Documents without notes, and those that cannot take any, stay as they are."""
    kind = dict(docs.dtypes)["doc_id"]
    fields = [f.split(":")[0].strip() for f in ("seq", "kind", "page_index", "rects", "x", "y", "red", "green", "blue", "contents")]
    lists = notes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(f"array<{NOTE}>").alias("notes"))
    return per_row(docs.select("doc_id", "content").join(lists, "doc_id", "left"), lambda i, data, own: [(i, _noted(data, own))], f"doc_id {kind}, content binary")


def _noted(data, notes):
    try:
        return annotation.append(data, notes) if data and notes else data
    except Exception:  # noqa: BLE001
        return data


def annotations(docs: DataFrame) -> DataFrame:
    """The annotations that pages list, by subtype and text."""

    def run(document):
        for k, p in enumerate(document.pages()):
            listed = document.deref(p.dictionary.get("Annots"))
            for order, ref in enumerate(listed if isinstance(listed, list) else []):
                a = document.deref(ref)
                if isinstance(a, dict):
                    said = document.deref(a.get("Contents"))
                    yield k, order, type_of(a, "Subtype"), said.decode("latin-1") if isinstance(said, bytes) else None, serialize(a.get("Rect", NULL))

    return _of(docs, run, "page_index int, ord int, subtype string, contents string, rect string")


def decode_streams(streams: DataFrame, limit: int | None = None, strict: bool = False) -> DataFrame:
    """id, data of streams(id, raw, filters array<string>, parms array<struct<predictor, colors, columns, bits>>); data
    is null where a filter is unknown or fails."""
    kind = dict(streams.dtypes)["id"]

    def run(i, raw, names, parms):
        own = [{"Predictor": p["predictor"] or 1, "Colors": p["colors"] or 1, "Columns": p["columns"] or 1, "BitsPerComponent": p["bits"] or 8} if p else NULL for p in parms or []]
        return [(i, None if raw is None else filters.decode(raw, {"Filter": [Name(n) for n in names or []], "DecodeParms": own}, strict=strict, limit=limit))]

    return per_row(streams.select("id", "raw", "filters", "parms"), run, f"id {kind}, data binary")

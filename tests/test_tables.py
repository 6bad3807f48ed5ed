"""Tables from corpora: what cannot be read costs no job, files come and go, and streams see what batches see."""

import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from leafspark.kernels import build
from leafspark.operators import pdf, selection
from leafspark.plans import fixtures
from leafspark.plans.queries import ORACLES, QUERIES
from leafspark.sources.pdf import read_pdfs, record_telemetry, slice_bytes, write_pdfs
from leafspark.streaming.pdf import stream_page_text, telemetry_by_minute

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def corpus(spark):
    good = fixtures.text_pdf("one\ntwo")
    files = [good, fixtures.packed_pdf("packed"), b"", None, b"%PDF-1.4 nothing", good[:-200], good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 1"), b"\xff" * 3000, build.classic({1: b"<< /Pages 1 0 R >>"}), build.text_pdf([b"BT (a) Tj ET <zz"], extra={100: b"<< /Type /Page /Contents 1 0 R >>"})]
    return spark.createDataFrame([(k, None if f is None else bytearray(f)) for k, f in enumerate(files)], "doc_id long, content binary").repartition(3)


def test_bad_documents_give_a_status_and_no_rows(corpus):
    got = {r["doc_id"]: r for r in pdf.statuses(corpus).collect()}
    assert {k for k, r in got.items() if r["status"] == "ok"} == {0, 1, 8, 9} and got[6]["status"] == "encrypted" and len(got) == 10
    text = {(r["doc_id"], r["page_index"]): r["text"] for r in pdf.page_text(corpus).collect()}
    assert text == {(0, 0): "one\ntwo", (1, 0): "packed", (9, 0): ""}
    for f in (pdf.xref, pdf.objects, pdf.dict_entries, pdf.pages, pdf.page_streams, pdf.fonts, pdf.cmaps, pdf.text_ops, pdf.toc, pdf.toc_json, pdf.named_destinations, pdf.private_blocks, pdf.first_private_blocks, pdf.annotations):
        assert {r["doc_id"] for r in f(corpus).collect()} <= {0, 1, 8, 9}


READERS = (pdf.statuses, pdf.xref, pdf.objects, pdf.dict_entries, pdf.pages, pdf.page_streams, pdf.fonts, pdf.cmaps, pdf.text_ops, pdf.page_text, pdf.toc, pdf.toc_json, pdf.named_destinations, pdf.private_blocks, pdf.first_private_blocks, pdf.annotations)


def _hostile() -> list[bytes]:
    good, digits = fixtures.text_pdf("one\ntwo"), b"7" * 5000
    widths = build.compressed({3: b"null"}, {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [] >>"}, flate=False)
    rows = widths.index(b"stream\n", widths.index(b"/XRef")) + 7
    wide = widths[:rows] + b"\x01" + b"\xff" * 8 + widths[rows + 9 :]
    return [
        good + b"\nstartxref\n" + digits + b"\n%%EOF",
        good.replace(b"/Kids", b"/Big " + digits + b" /Kids"),
        good.replace(b"00000 n", b"99999999999 n"),
        good.replace(b"0000000000 65535 f", b"99999999999999999999 65535 f"),
        build.text_pdf([b"BT /F1 9 Tf (a) Tj " + digits + b" 0 Td (b) Tj ET"]),
        build.text_pdf([b"BT /F1 9 Tf (a) Tj 1" + b"0" * 400 + b" 0 Td (b) Tj 1" + b"0" * 400 + b".0 TL ET"]),
        build.text_pdf([b"[" * 100000 + b"<<" * 100000]),
        build.text_pdf([b"x"], extra={100: b"<< /Type /Page /Contents 101 0 R /PieceInfo << /Illustrator << /Private << /AIPrivateData" + digits + b" (x) >> >> >> >>"}),
        wide.replace(b"/W [1 4 2]", b"/W [1 8 0]").replace(b"/W [1 4 2]", b"/W [1 8 0]"),
        build.text_pdf([b"x"], extra={1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 1 0 R /First 1 0 R /Names 1 0 R /Dests 1 0 R >>"}),
        build.text_pdf([b"x"], extra={2: b"<< /Type /Pages /Kids [2 0 R [1 2] null 3 0 R (x)] /MediaBox [1 2] >>"}),
    ]


def test_no_file_ends_the_job(spark):
    """Hostile files and random damage, beside one good document that every operator must still read."""
    r = random.Random(4)
    bases = [fixtures.text_pdf("one\ntwo"), fixtures.packed_pdf("packed"), fixtures.outline_pdf([("a", ["b", "c"])], "named"), fixtures.blocks_pdf(["x", "y"]), build.unicode_pdf("aé")]
    files = _hostile()
    for _ in range(400):
        data = bytearray(r.choice(bases))
        for _ in range(r.randrange(1, 6)):
            at = r.randrange(len(data))
            data[at : at + r.randrange(4)] = r.choice([b"", b"<<", b">>", b"9" * 30, b"[", b"(", bytes([r.randrange(256)]), b" 0 R", b"-1", b"/"])
        files.append(bytes(data))
    good = 10**6
    docs = spark.createDataFrame([(k, bytearray(f)) for k, f in enumerate([*files])] + [(good, bytearray(fixtures.outline_pdf([("a", ["b"])], "named")))], "doc_id long, content binary").repartition(4)
    assert pdf.statuses(docs).count() == len(files) + 1
    for f in READERS:
        got = {row["doc_id"] for row in f(docs).select("doc_id").collect()}
        assert good in got or f in (pdf.cmaps, pdf.private_blocks, pdf.first_private_blocks, pdf.annotations), f
    notes = docs.select("doc_id", F.lit(1).alias("seq"), F.lit("note").alias("kind"), F.lit(0).alias("page_index"), F.lit(None).cast("array<struct<left: float, top: float, right: float, bottom: float>>").alias("rects"), *(F.lit(float(k)).cast("float").alias(c) for k, c in enumerate(("x", "y", "red", "green", "blue"))), F.lit("hi").alias("contents"))
    assert pdf.annotate(docs, notes).count() == len(files) + 1


def test_one_page_of_each(spark, corpus):
    made = build.text_pdf([build.lines_content(f"page {k}") for k in range(4)])
    docs = spark.createDataFrame([(1, bytearray(made), 2), (2, bytearray(made), 9), (3, bytearray(made), None), (4, bytearray(made), -1)], "doc_id long, content binary, at int")
    assert [tuple(r) for r in pdf.page_text(docs, page=F.col("at")).collect()] == [(1, 2, "page 2")]
    assert {tuple(r) for r in pdf.page_text(docs, page=1).collect()} == {(k, 1, "page 1") for k in (1, 2, 3, 4)}
    assert pdf.page_text(docs, page=4).isEmpty()


def test_page_trees_with_cycles(spark):
    rows = [(1, "r", None, "0", "r", "R", False), (1, "a", "r", "1", "a", None, False), (1, "x", "a", "0", "x", None, True), (1, "r", "a", "1", "r", None, False), (1, "y", "r", "0", "y", "Y", True), (2, "r", None, "0", "r", None, False), (2, "z", "r", "0", "z", None, True)]
    nodes = spark.createDataFrame(rows, "doc_id long, id string, parent string, ord string, name string, own string, leaf boolean")
    assert sorted(map(tuple, pdf.page_tree(nodes).collect())) == [(1, 0, "y", "Y"), (1, 1, "x", "R"), (2, 0, "z", None)]


def test_page_trees_have_no_limits(spark):
    deep = [(1, str(k), str(k - 1) if k else None, "0", str(k), "R" if k == 3 else None, k == 7) for k in range(8)]
    nodes = spark.createDataFrame(deep, "doc_id long, id string, parent string, ord string, name string, own string, leaf boolean").coalesce(1)
    assert [tuple(r) for r in pdf.page_tree(nodes).collect()] == [(1, 0, "7", "R")]
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "-1"


def test_tables_of_one_document(corpus):
    one = corpus.where("doc_id = 0")
    assert [(r["operator"], r["operands"]) for r in pdf.text_ops(one).collect()][:3] == [("BT", []), ("Tf", ["/F1", "12"]), ("Td", ["72", "720"])]
    page = pdf.pages(one).first()
    assert page["obj_num"] == 100 and page["media_box"] == [0.0, 0.0, 612.0, 792.0] and page["contents"][0]["num"] == 101
    assert pdf.page_streams(one).first()["data"].startswith(b"BT") and pdf.fonts(one).first()["code_width"] == 1


def test_plans_push_and_prune(spark, corpus):
    plan = pdf.page_text(corpus.withColumn("more", F.lit("x" * 10)))._jdf.queryExecution().optimizedPlan().toString()
    assert "more" not in plan


@pytest.mark.parametrize("name", [*QUERIES])
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = sorted(got.columns)
    assert sorted(d[0] for d in cursor.description) == names
    order = [[d[0] for d in cursor.description].index(n) for n in names]
    row = lambda values: tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in values)
    assert sorted(row(r[n] for n in names) for r in got.collect()) == sorted(row(r[i] for i in order) for r in cursor.fetchall())


def test_revisions(spark):
    rows = spark.createDataFrame([(1, 0.0, "f"), (1, 1.0, "n"), (2, 1.0, "n"), (2, 1.0, "m"), (2, 2.0, "n")], "obj int, rev_rank double, kind string")
    assert sorted(map(tuple, pdf.merge_revisions(rows, ["obj"]).collect())) == [(1, 0.0, "f"), (2, 1.0, "m"), (2, 1.0, "n")]


def test_files_and_stream(spark, corpus, tmp_path):
    folder = tmp_path / "pdfs"
    wrote = write_pdfs(corpus.where("doc_id in (0, 1, 4)"), str(folder)).collect()
    assert len(wrote) == 3 and sorted(p.name for p in folder.iterdir()) == ["0.pdf", "1.pdf", "4.pdf"]
    files = read_pdfs(spark, str(folder))
    assert sorted(r["text"] for r in pdf.page_text(files).collect()) == ["one\ntwo", "packed"]
    assert read_pdfs(spark, str(folder), most_bytes=100).count() == 1
    assert bytes(files.select(slice_bytes(F.col("content"), 1, 3).alias("b")).first()["b"]) == b"PDF"
    q = stream_page_text(spark, str(folder)).writeStream.format("memory").queryName("texts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["text"] for r in spark.sql("SELECT text FROM texts").collect()) == ["one\ntwo", "packed"]


def test_telemetry(spark, tmp_path):
    event = (1, 800, 800, 600, True, False, 1, 2, 3, 4, 10, "SUCCESS")
    events = spark.createDataFrame([event, (1, 800, None, None, False, True, 1, 2, 3, 4, 30, "STALE")], selection.TELEMETRY)
    record_telemetry(events, None)
    record_telemetry(events, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    got = selection.telemetry_summary(events).first()
    assert (got["renders"], got["successes"], got["slowest_ms"]) == (2, 1, 30)
    assert telemetry_by_minute(events.withColumn("ts", F.current_timestamp())).count() == 2


def test_annotate_keeps_documents_without_notes(spark, corpus):
    notes = spark.createDataFrame([(0, 1, "note", 0, None, 1.0, 2.0, 1.0, 1.0, 0.0, "hi"), (5, 1, "note", 0, None, 1.0, 2.0, 1.0, 1.0, 0.0, "hi")], "doc_id long, " + pdf.NOTE[len("struct<") : -1])
    got = {r["doc_id"]: r["content"] for r in pdf.annotate(corpus, notes).collect()}
    was = {r["doc_id"]: r["content"] for r in corpus.collect()}
    assert len(got) == 10 and [k for k in got if got[k] != was[k]] == [0]


def test_library_does_not_need_the_training_data_part():
    code = "import sys; sys.modules['leafspark.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport importlib, pkgutil, leafspark\nfor m in pkgutil.walk_packages(leafspark.__path__, 'leafspark.'):\n    if '.llm' not in m.name: importlib.import_module(m.name)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def _same_as_sql(spark, folder, name, **tables):
    """A query over rows of one's own is its SQL."""
    con = duckdb.connect()
    for t, frame in tables.items():
        con.execute(f"COPY ({frame}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want


#: More suppliers of a nation than there were numbers for, half of them with names that others have.
MANY_SUPPLIERS = "SELECT i AS s_suppkey, 'Supplier#' || CASE WHEN i % 2 = 0 THEN i % 50 ELSE i END AS s_name, (i % 3 // 2)::INTEGER AS s_nationkey FROM range(1800) r(i)"


def test_named_destinations_of_many_suppliers(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "named_destinations", supplier=MANY_SUPPLIERS)


def test_toc_of_many_suppliers(spark, tmp_path):
    _same_as_sql(spark, tmp_path, "toc_named_dest", supplier=MANY_SUPPLIERS)


def test_pdfs_are_made_on_all_cores(spark):
    """A table of one task gives PDFs in some tasks for each core, none of them much longer than others."""
    rows = spark.range(600).coalesce(1).selectExpr("id AS doc_id", "'x' AS text")
    made = fixtures.pdfs(rows, fixtures.text_pdf)
    sizes = [n for (n,) in made.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) >= 2 * spark.sparkContext.defaultParallelism and max(sizes) < 2 * 600 / len(sizes)

"""PDFs from table rows, built on the executors: the driver's tables hold none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafspark.kernels import build
from leafspark.operators.kernel import per_row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows in some tasks for each core: a small table is read in few, but the files made of its rows are not small."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism)


def pdfs(rows: DataFrame, builder) -> DataFrame:
    """docs(doc_id, content) of rows(doc_id, ...): builder(the other columns) gives the bytes."""
    kind = dict(rows.dtypes)["doc_id"]
    return per_row(spread(rows), lambda doc_id, *values: [(doc_id, builder(*values))], f"doc_id {kind}, content binary")


def text_pdf(text: str | None) -> bytes:
    """One page of one-byte text."""
    return build.text_pdf([build.lines_content(text or "")])


def two_page_pdf(text: str | None, catalog: str = "", extra: dict[int, bytes] | None = None) -> bytes:
    return build.text_pdf([build.lines_content(text or ""), build.lines_content("second page")], extra=extra, catalog=catalog)


def packed_pdf(text: str | None) -> bytes:
    """One page whose objects are in an object stream behind a predicted cross-reference stream."""
    packed = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 5 0 R /Resources << /Font << /F1 4 0 R >> >> >>",
        4: build.FONT,
    }
    return build.compressed({5: build.flate_stream(build.lines_content(text or ""))}, packed, predictor=True)


def outline_pdf(chapters: list[tuple[str, list[str]]], destinations: str = "direct") -> bytes:
    """A page for each section; chapters and sections as outline items. Destinations are arrays, or names in a tree: the
    titles, or ("numbered") titles with #, page and so many digits that no two are alike."""
    titles = [t for _, sections in chapters for t in sections]
    pages = [build.lines_content(t) for t in titles]
    names = [f"{t}#{k:09d}" for k, t in enumerate(titles)] if destinations == "numbered" else titles
    dest = lambda k: f"[{100 + 2 * k} 0 R /Fit]" if destinations == "direct" else f"({_plain(names[k])})"
    # Pages and their contents have the numbers from 100 on, as many as there are.
    top = 100 + 2 * len(titles)
    tree, leaf = top + 1, top + 2
    extra, number, k = {}, top + 3, 0
    heads = []
    for _, sections in chapters:
        heads.append(number)
        number += 1 + len(sections)
    for c, (title, sections) in enumerate(chapters):
        head = heads[c]
        below = f" /First {head + 1} 0 R /Last {head + len(sections)} 0 R" if sections else ""
        onward = f" /Next {heads[c + 1]} 0 R" if c + 1 < len(heads) else ""
        extra[head] = f"<< /Title ({_plain(title)}) /Parent {top} 0 R /Dest {dest(k)}{below}{onward} >>".encode("latin-1", "replace")
        for s, section in enumerate(sections):
            onward = f" /Next {head + 2 + s} 0 R" if s + 1 < len(sections) else ""
            extra[head + 1 + s] = f"<< /Title ({_plain(section)}) /Parent {head} 0 R /A << /S /GoTo /D {dest(k)} >>{onward} >>".encode("latin-1", "replace")
            k += 1
    extra[top] = f"<< /Type /Outlines /First {heads[0]} 0 R /Last {heads[-1]} 0 R >>".encode()
    listed = " ".join(f"({_plain(t)}) [{100 + 2 * i} 0 R /Fit]" for i, t in enumerate(names))
    extra[tree] = f"<< /Kids [{leaf} 0 R] >>".encode()
    extra[leaf] = f"<< /Names [{listed}] >>".encode("latin-1", "replace")
    return build.text_pdf(pages, extra=extra, catalog=f" /Outlines {top} 0 R /Names << /Dests {tree} 0 R >>")


def blocks_pdf(values: list[str]) -> bytes:
    """Blocks in turn as strings and as streams, on the second page."""
    entries, extra = [], {}
    for k, v in enumerate(values, 1):
        if k % 2:
            entries.append(f"/AIPrivateData{k} <{v.encode().hex()}>")
        else:
            extra[1000 + k] = build.flate_stream(v.encode())
            entries.append(f"/AIPrivateData{k} {1000 + k} 0 R")
    page = f"<< /Type /Page /Parent 2 0 R /PieceInfo << /Illustrator << /Private << /NumBlock {len(values)} {' '.join(reversed(entries))} >> >> >> >>"
    return build.text_pdf([build.lines_content("cover"), b""], extra={102: page.encode(), **extra})


def _plain(text: str) -> str:
    return text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")

"""PDF files as DataFrames, and back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pdfs(spark: SparkSession, path: str, pattern: str = "*.pdf", most_bytes: int | None = None) -> DataFrame:
    """doc_id (a hash of the path), path, length, content of the files under a path. A bound on the length is pushed
    down to the listing: larger files are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def write_pdfs(docs: DataFrame, folder: str) -> DataFrame:
    """Writes docs(doc_id, content) as <folder>/<doc_id>.pdf and returns doc_id, path, length. The folder must be one
    that all executors share. A file appears whole or not at all, so a task that is run again does no harm."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        store.create_dir(root, recursive=True)
        for batch in batches:
            ids, paths, lengths = [], [], []
            for doc_id, content in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{root}/{doc_id}.pdf"
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content or b"")
                store.move(part, path)
                ids.append(doc_id)
                paths.append(path)
                lengths.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(lengths, pa.int64())], ["doc_id", "path", "length"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "content").mapInArrow(run, "doc_id long, path string, length long")


def record_telemetry(events: DataFrame, table: str | None) -> None:
    """Writes telemetry events as a table's files; None takes them and does nothing."""
    if table is None:
        events.write.format("noop").mode("overwrite").save()
    else:
        events.write.mode("append").parquet(table)


def slice_bytes(content: Column, start: int | Column, count: int | Column) -> Column:
    """A column of count bytes from an offset (from 0); fewer at the end."""
    return F.substring(content, start + 1, count)

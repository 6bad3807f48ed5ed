"""Streams of PDF files and of telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.operators import pdf

FILE = "path string, modificationTime timestamp, length long, content binary"


def stream_pdfs(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """doc_id, path, content of PDF files as they come into a folder."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def stream_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """Page texts of arriving files; stateless, so every output mode but complete will do."""
    return pdf.page_text(stream_pdfs(spark, folder))


def telemetry_by_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Renders and slowest time by minute and result, of events with a time ts."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "result").agg(F.count("*").alias("renders"), F.max("total_ms").alias("slowest_ms"))

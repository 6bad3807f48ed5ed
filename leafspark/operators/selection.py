"""Words selected in text, and telemetry of rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.functions.geometry import word_steps
from leafspark.kernels.words import selected, word_at
from leafspark.operators.kernel import per_row

TELEMETRY = (
    "page int, requested_width int, rendered_width int, rendered_height int, cache_hit boolean, used_fallback_width boolean, "
    "wait_for_lock_ms long, open_page_ms long, allocate_bitmap_ms long, render_ms long, total_ms long, result string"
)
RESULTS = ("SUCCESS", "FAILURE", "OUT_OF_MEMORY", "DOCUMENT_CLOSED", "INVALID_PAGE", "STALE")


def words_at(probes: DataFrame) -> DataFrame:
    """id, start, end, word of probes(id, text, offset): the word at the offset or close to it, else nulls."""
    kind = dict(probes.dtypes)["id"]

    def run(i, text, offset):
        span = None if offset is None else word_at(text, offset)
        return [(i, *(span or (None, None)), selected(text, span) if span else None)]

    return per_row(probes.select("id", "text", "offset"), run, f"id {kind}, start int, end int, word string")


def word_rects(words: DataFrame) -> DataFrame:
    """words(fragment, left, right, press_y, ...) with word: each selected word's rectangle, as geometry.word_steps() says. Each
    step is a column of its own, computed once."""
    made: list[str] = []
    for step in word_steps("fragment", "left", "right", "press_y"):
        words = words.withColumns(step)
        made += [c for c in step if c != "word"]
    return words.drop(*made)


def telemetry_summary(events: DataFrame) -> DataFrame:
    """An extension: outcomes, cache hits and times by page."""
    return events.groupBy("page").agg(
        F.count("*").alias("renders"),
        F.sum((F.col("result") == "SUCCESS").cast("long")).alias("successes"),
        F.sum(F.col("cache_hit").cast("long")).alias("cache_hits"),
        F.sum(F.col("used_fallback_width").cast("long")).alias("fallbacks"),
        F.max("total_ms").alias("slowest_ms"),
        F.sum("total_ms").alias("total_ms"),
    )


def dedup_requests(requests: DataFrame) -> DataFrame:
    """Requests that differ in more than generation and reason, once each: the most urgent reason stands."""
    return requests.groupBy("page", "target_width", "tile").agg(F.min("priority").alias("priority"), F.max("generation").alias("generation"))

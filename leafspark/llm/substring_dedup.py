"""Exact removal of repeated passages with a log-structured fingerprint index.

A window is WINDOW consecutive words. Every window is governed by an anchor: the least hash of the GRAM-word grams in
it. A gram that governs windows in one text does so wherever those windows occur, so the index needs an entry for each
anchor and not for each window: about one in twenty words. An entry holds the anchor's hash (mh), the hash of all words
of the windows that it governs there (ctx), and where they start.

Batches of documents enter in order of doc_id. The new entries are merge-joined with the sorted immutable runs of
earlier batches on (mh, ctx): an entry found there, or in a smaller document of its own batch, repeats all its windows.
Other entries form a new sorted run; runs are compacted when there are more than FANOUT of them. An index in a folder
stays there, and is opened again for the next day's documents.

An anchor whose windows occur with different ctx may share some windows and not others. These are verified: the windows
of such entries (of each ctx, all places in its least document) are hashed one by one from the texts, and each goes to
the least doc_id. Hashes are 64 bits of mh and 64 bits of ctx or window, together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafspark.llm.common import arrow_map, drop, keep, small_batches, text_bytes, written

WINDOW, GRAM, BATCHES, FANOUT = 50, 8, 3, 2
_GRAMS = WINDOW - GRAM + 1
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_ENTRY = "mh long, ctx long, doc_id long, t long, first int, last int"
_EMPTY = hashlib.sha256(b"").digest()


class _WordHashes(dict):
    """64-bit hashes of words, remembered until there are a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word, 7)
        return got


_hash = _WordHashes()
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _BACK)):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, b, np.uint64))])
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


class Hashed:
    """Prefix sums over a text's words, from which the hash of any run of words follows."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        up, self.down = _power(n + 1)
        x = np.fromiter(map(_hash.__getitem__, words), np.uint64, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[:n])])

    def runs(self, first: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[first + length] - self.sums[first]) * self.down[first])


def words_of(text: str | None) -> list[bytes]:
    return text_bytes(text).split()


def anchors(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """mh, ctx, first and last window start of each anchor; adjoining anchors alike in mh and ctx are one."""
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < WINDOW:
        return none, none, none.astype(np.int32), none.astype(np.int32)
    hashed = Hashed(words)
    grams = hashed.runs(np.arange(n - GRAM + 1), GRAM)
    starts = np.arange(n - WINDOW + 1)
    at = starts + np.lib.stride_tricks.sliding_window_view(grams, _GRAMS).argmin(axis=1)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    first, last, at = starts[new], np.append(starts[new[1:] - 1], starts[-1]), at[new]
    mh = grams[at]
    shape = ((at - first) * 64 + (at - last)).astype(np.uint64)
    ctx = _mix(hashed.runs(first, last - first + WINDOW) + shape * np.uint64(_BASE))
    fresh = np.flatnonzero(np.concatenate([[True], (mh[1:] != mh[:-1]) | (ctx[1:] != ctx[:-1])]))
    ends = np.append(fresh[1:] - 1, len(mh) - 1)
    return mh[fresh].view(np.int64), ctx[fresh].view(np.int64), first[fresh].astype(np.int32), last[ends].astype(np.int32)


def _text_key(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(text_bytes(text)) - (1 << 63)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text, which tells rows of one doc_id apart), sha (of the words joined by one space),
    n_words, anchors of every row."""
    small_batches(docs.sparkSession)
    entry = pa.struct([("mh", pa.int64()), ("ctx", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("sha", pa.binary()), ("n_words", pa.int64()), ("anchors", pa.list_(entry))])

    def run(batches):
        for batch in batches:
            keys, shas, counts, parts = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                keys.append(_text_key(text))
                shas.append(hashlib.sha256(b" ".join(words)).digest())
                counts.append(len(words))
                parts.append(anchors(words))
            columns = [pa.array(np.concatenate(c)) for c in zip(*parts)] if parts else [pa.array([], f.type) for f in entry]
            offsets = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(entry)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(shas, pa.binary()), pa.array(counts, pa.int64()), lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, t long, sha binary, n_words long, anchors array<struct<mh: long, ctx: long, first: int, last: int>>")


class FingerprintIndex:
    """Runs of entries (mh, ctx, doc_id, t, first, last), sorted by (mh, ctx) and never changed: of each (mh, ctx), every
    place in the least document that holds it.

    With a folder (one that all executors share), runs are written there as run-<from>-<to> by the numbers of their
    batches, and an index on the same folder has them again. A run counts once it is written whole; one that a compacted
    run contains does not. One writer at a time."""

    def __init__(self, fanout: int = FANOUT, folder: str | None = None, spark: SparkSession | None = None):
        self.fanout, self.folder = fanout, folder
        self.runs: list[tuple[int, int, DataFrame]] = []
        if folder is not None:
            found = sorted((tuple(map(int, name[4:].split("-"))) for name in written(spark, folder) if name.startswith("run-")), key=lambda r: (r[0], -r[1]))
            for first, last in found:
                if not self.runs or first > self.runs[-1][1]:
                    self.runs.append((first, last, spark.read.schema(_ENTRY).parquet(f"{folder}/run-{first}-{last}")))

    def history(self) -> DataFrame | None:
        out = None
        for _, _, run in self.runs:
            out = run if out is None else out.unionByName(run)
        return out

    def greatest(self) -> int | None:
        """The greatest doc_id in the index."""
        past = self.history()
        return None if past is None else past.agg(F.max("doc_id")).first()[0]

    def _write(self, entries: DataFrame, first: int, last: int) -> tuple[int, int, DataFrame]:
        if self.folder is None:
            return first, last, keep(entries, "run")
        path = f"{self.folder}/run-{first}-{last}"
        entries.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return first, last, entries.sparkSession.read.schema(_ENTRY).parquet(path)

    def append(self, entries: DataFrame) -> DataFrame:
        """Merge-joins a batch whose doc_ids are all greater than the history's, and returns the repeats: doc_id, t,
        first, last of entries that a smaller document has."""
        # What repeats is a table of its own, so that Spark can split the join for a passage that very many have.
        known = entries.groupBy("mh", "ctx").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        past = self.history()
        if past is None:
            known = known.where("low < high").select("mh", "ctx", F.col("low").alias("least"))
        else:
            before = past.groupBy("mh", "ctx").agg(F.first("doc_id").alias("past"))
            known = known.join(before.hint("merge"), ["mh", "ctx"], "left").where("past is not null or low < high").select("mh", "ctx", F.coalesce("past", "low").alias("least"))
        met = entries.join(keep(known, "repeated").hint("merge"), ["mh", "ctx"], "left")
        met = keep(met.withColumn("repeats", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))).drop("least"), "batch")
        # What does not repeat is in the least document, maybe at several places: any of them may have to go.
        n = self.runs[-1][1] + 1 if self.runs else 0
        run = met.where("not repeats").select("mh", "ctx", "doc_id", "t", "first", "last")
        self.runs.append(self._write(run.sortWithinPartitions("mh", "ctx"), n, n))
        if len(self.runs) > self.fanout:
            self.compact()
        return met.where("repeats").select("doc_id", "t", "first", "last")

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) > 1:
            older, merged = self.runs, self.history().repartition("mh", "ctx").sortWithinPartitions("mh", "ctx")
            self.runs = [self._write(merged, older[0][0], older[-1][1])]
            for _, _, run in older:
                drop(run)

    def doubtful(self, since: int | None = None) -> DataFrame | None:
        """Entries whose anchor governs different windows elsewhere; of anchors that documents from `since` on have."""
        past = self.history()
        if past is None:
            return None
        several = past.groupBy("mh").agg(F.min("ctx").alias("low"), F.max("ctx").alias("high"), F.max("doc_id").alias("newest")).where("low < high")
        if since is not None:
            several = several.where(F.col("newest") >= since)
        return past.join(keep(several.select("mh"), "several").hint("merge"), "mh", "left_semi")


def _ranges(spans: DataFrame) -> DataFrame:
    """doc_id, t, spans: ordered, not touching, in words (end exclusive); n_removed. From doc_id, t, first, last of
    windows."""

    def merge(ids, texts, lists):
        out, counts = [], []
        for spans in lists:
            got: list[list[int]] = []
            for a, b in sorted((s["first"], s["last"] + WINDOW) for s in spans):
                if got and a <= got[-1][1]:
                    got[-1][1] = max(got[-1][1], b)
                else:
                    got.append([a, b])
            out.append([{"a": a, "b": b} for a, b in got])
            counts.append(sum(b - a for a, b in got))
        return [ids, texts, out, counts]

    # A text has at most as many spans as anchors and verified windows.
    lists = spans.groupBy("doc_id", "t").agg(F.collect_set(F.struct("first", "last")).alias("l"))
    return arrow_map(lists, merge, "doc_id long, t long, spans array<struct<a: int, b: int>>, n_removed long")


def _pack(ids, texts):
    z = zstandard.ZstdCompressor(3)
    return [ids, [_text_key(t) for t in texts], [z.compress(text_bytes(t)) for t in texts]]


def _unpack(z: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(z).split()


def _windows(ids, texts, packed, lists):
    """One row for each window of the entries: doc_id, t, mh, wh, start."""
    out = [[np.zeros(0, np.int64)] for _ in range(5)]
    for i, t, z, entries in zip(ids, texts, packed, lists):
        words = _unpack(z)
        entries = [e for e in entries if e["last"] + WINDOW <= len(words)]
        if not entries:
            continue
        first, last, mh = (np.array([e[k] for e in entries], np.int64) for k in ("first", "last", "mh"))
        n = last - first + 1
        # The windows of all entries, one after another.
        start = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
        hashes = Hashed(words).runs(start, WINDOW).view(np.int64)
        for column, values in zip(out, (np.full(len(start), i), np.full(len(start), t), np.repeat(mh, n), hashes, start)):
            column.append(values)
    docs, of, anchor, window, start = map(np.concatenate, out)
    return [docs, of, anchor, window, start.astype(np.int32)]


def _finish(ids, texts, packed, lists, counts, n_words):
    shas = []
    for z, spans in zip(packed, lists):
        words, kept, at = _unpack(z), [], 0
        for s in spans:
            kept += words[at : s["a"]]
            at = s["b"]
        shas.append(hashlib.sha256(b" ".join(kept + words[at:])).digest())
    return [ids, texts, n_words, counts, shas]


def repeated_passages(docs: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs(doc_id, text, ...).

    A word goes if a window over it also starts in a document of smaller doc_id, on the input as it was. Null and empty
    texts have no words and lose none, nor do texts of under 50 words. Rows without a doc_id are neither smaller nor
    larger than others: they lose nothing and nothing goes for them. Rows that share a doc_id are each a text of that
    document: nothing goes from one for another's sake, and each gets its own row. An empty table gives an empty one;
    other columns are not read; very long texts are read whole.

    With the index of earlier documents, which takes these in, and the table of those documents, passages go for the sake
    of both; doc_ids must be greater than theirs.
    """
    index = index or FingerprintIndex()
    past = index.greatest()
    sketch = keep(sketches(docs), "sketches")
    entered = sketch.where("doc_id is not null").select("doc_id", "t", F.explode("anchors").alias("e")).select("e.mh", "e.ctx", "doc_id", "t", "e.first", "e.last")
    least, bounds = sketch.agg(F.min("doc_id"), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)]) if batches > 1 else F.array()).first()
    if past is not None and least is not None and least <= past:
        raise ValueError(f"the index holds document {past}, and these begin with {least}")
    cuts = [None, *sorted(set(bounds or [])), None]
    found = None
    for low, high in zip(cuts, cuts[1:]):
        batch = entered
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        repeats = index.append(batch)
        found = repeats if found is None else found.union(repeats)
    index.compact()
    text = ["doc_id", "t"]
    sure = keep(_ranges(found), "ranges")
    doubtful = keep(index.doubtful(least if past is not None else None).groupBy(*text).agg(F.collect_set(F.struct("mh", "first", "last")).alias("entries")), "doubtful")
    lengths = sketch.where("doc_id is not null").select(*text, "n_words").distinct()
    # Documents that go as a whole need no text, unless a window to verify may first be in them.
    whole = sure.join(lengths, text).where("n_removed >= n_words").select(*text).join(doubtful, text, "left_anti")
    # Texts are moved once: of documents that lose some words, but not all, or have windows to verify.
    wanted = sure.select(*text).union(doubtful.select(*text)).distinct().join(whole, text, "left_anti")
    rows = docs.select("doc_id", "text") if earlier is None else docs.select("doc_id", "text").union(earlier.select("doc_id", "text"))
    texts = arrow_map(rows.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _pack, "doc_id long, t long, z binary")
    texts = keep(texts.join(wanted, text, "left_semi").dropDuplicates(text), "texts")
    windows = keep(arrow_map(texts.join(doubtful, text).select(*text, "z", "entries"), _windows, "doc_id long, t long, mh long, wh long, start int"), "windows")
    first = keep(windows.groupBy("mh", "wh").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("mh", "wh", "least"), "least")
    more = windows.join(first.hint("merge"), ["mh", "wh"]).where("doc_id > least").select(*text, F.col("start").alias("first"), F.col("start").alias("last"))
    spans = found.join(texts.select(*text), text, "left_semi").union(more)
    ranges = _ranges(spans).join(lengths, text)
    cut = arrow_map(texts.join(ranges, text).select(*text, "z", "spans", "n_removed", "n_words"), _finish, "doc_id long, t long, n_words long, n_removed long, kept binary")
    answer = cut.select(*text, "n_removed", "kept").union(whole.join(lengths, text).select(*text, F.col("n_words").alias("n_removed"), F.lit(_EMPTY).alias("kept")))
    return sketch.select(*text, "n_words", "sha").join(answer, text, "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.lower(F.hex(F.coalesce("kept", "sha"))).alias("kept_sha256")
    )

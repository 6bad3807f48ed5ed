"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of test items.

Texts and items are normalised alike: A-Z in lower case, words of letters, digits and anything beyond ASCII. The
automaton's alphabet is words (by number), so each text is scanned once, word by word, whatever the windows. Word k of
a text keeps its place in the original, so hits map back to offsets there.

Items are gathered in blocks of a bounded size. Test sets of usual size are one block; of more, each is a pass of its
own, so that one automaton is alive at a time. A worker builds it once, however many tasks it runs.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.llm.common import arrow_filter, arrow_map, keep, text_bytes

WINDOW = 13
#: Words of the items in one automaton; about 0.5 KB each.
BLOCK_WORDS = 200_000
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(FOLD).split()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each word of normal_words() lies in text: code points, end exclusive."""
    raw = text_bytes(text)
    flat, spans, at = raw.translate(FOLD), [], 0
    starts = [0]
    for ch in text:
        starts.append(starts[-1] + len(ch.encode("utf-8", "surrogatepass")))
    point = {b: i for i, b in enumerate(starts)}
    for word in flat.split():
        at = flat.index(word, at)
        spans.append((point[at], point[at + len(word)]))
        at += len(word)
    return spans




class _Numbers(dict):
    """Numbers of the items' words from 1 on; 0 of any other word."""

    def __missing__(self, word: bytes) -> int:
        return 0


class Automaton:
    """The windows of a block of items. find(words) gives the places of hits as (first word, end word, items). A word that
    no item has brings the automaton back to its root, so only runs of known words as long as the least window are scanned."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.number = _Numbers()
        owners: dict[tuple[int, ...], list] = {}
        for item, text in items:
            words = normal_words(text)
            if not words:
                continue
            seq = tuple(self.number.setdefault(w, len(self.number) + 1) for w in words)
            for at in range(max(1, len(seq) - window + 1)):
                owner = owners.setdefault(seq[at : at + window], [])
                if not owner or owner[-1] != item:
                    owner.append(item)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seq, who in owners.items():
            self.tree.add_word(seq, (len(seq), tuple(who)))
        if owners:
            self.tree.make_automaton()
        self.least = min(map(len, owners), default=0)

    def find(self, words: list[bytes]) -> list[tuple[int, int, tuple]]:
        if not self.least or len(words) < self.least:
            return []
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        unknown = np.flatnonzero(numbers == 0)
        starts, ends = np.append(0, unknown + 1), np.append(unknown, len(words))
        long, out = np.flatnonzero(ends - starts >= self.least), []
        for first, end in zip(starts[long].tolist(), ends[long].tolist()):
            out += [(first + at - n + 1, first + at + 1, who) for at, (n, who) in self.tree.iter(tuple(numbers[first:end].tolist()))]
        return out


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """items(item_id, text) in blocks of at most about block_words words each, by running size over hashed buckets."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // (4 * block_words)))
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


#: The automaton of this worker process, after the name of its block.
_alive: dict[str, Automaton] = {}


def _automaton(block: str, rows) -> Automaton:
    if block not in _alive:
        _alive.clear()
        _alive[block] = Automaton(rows.value)
    return _alive[block]


def _matcher(items: DataFrame):
    """get() gives the automaton of a block of items, on an executor; and the broadcast that it is built from."""
    rows = [(r["item_id"], r["text"]) for r in items.select("item_id", "text").collect()]  # one bounded block
    block, shared = uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast(rows)
    return lambda: _automaton(block, shared), shared


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as ordered spans that do not touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_FOUND = "spans array<struct<first: int, end: int>>, items array<string>"


def _scan(words: list[bytes], found: Automaton) -> tuple[list[dict], list[str]]:
    got = found.find(words)
    return [{"first": a, "end": b} for a, b in covered([h[:2] for h in got])], sorted({str(i) for h in got for i in h[2] if i is not None})


def _offsets(text: str | None, spans: list[tuple[int, int]]) -> str:
    return ",".join(f"{a}:{b}" for a, b in original_spans(text, spans)) if spans else ""


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (array of hit words' first, end), items (ids as strings) and hit_spans (the spans in code
    points of the original, "first:end", comma-joined) of every row.

    Each text is scanned once per block of items, whole, however long it is. Null and empty texts have no words and no
    hits; an item shorter than a window is one window, one without words has none. Windows of an item without an id hit
    words, but it is not among the items that are named and counted."""
    blocks, kind = item_blocks(items), dict(docs.dtypes)["doc_id"]
    if len(blocks) == 1:
        get = _matcher(items)[0]

        def scan(ids, texts):
            n_words, spans, found, offsets = [], [], [], []
            for text in texts:
                words = normal_words(text)
                own, who = _scan(words, get())
                n_words.append(len(words))
                spans.append(own)
                found.append(who)
                offsets.append(_offsets(text, [(s["first"], s["end"]) for s in own]))
            return [ids, n_words, spans, found, offsets]

        return arrow_map(docs.select("doc_id", "text"), scan, f"doc_id {kind}, n_words long, {_FOUND}, hit_spans string")

    def key(i, text):  # rows alike in both have the same hits
        return xxhash.xxh3_128_digest(f"{i}|".encode() + text_bytes(text))

    found = None
    for block in blocks:
        get, rows = _matcher(block)

        def scan(ids, texts, get=get):
            out = [(key(i, t), *_scan(normal_words(t), get())) for i, t in zip(ids, texts)]
            out = [x for x in out if x[1]]
            return [[x[k] for x in out] for k in range(3)]

        part = keep(arrow_map(docs.select("doc_id", "text"), scan, f"row binary, {_FOUND}"), "hits")
        rows.unpersist()
        found = part if found is None else found.union(part)
    # Of a row, as many as there are blocks, and as many spans as it has words.
    found = found.groupBy("row").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def count(ids, texts):
        return [ids, [key(i, t) for i, t in zip(ids, texts)], [len(normal_words(t)) for t in texts], texts]

    def whole(ids, n_words, texts, spans, who):
        merged = [covered([(s["first"], s["end"]) for s in own or []]) for own in spans]
        return [ids, n_words, [[{"first": a, "end": b} for a, b in m] for m in merged], [w or [] for w in who], [_offsets(t, m) for t, m in zip(texts, merged)]]

    rows = arrow_map(docs.select("doc_id", "text"), count, f"doc_id {kind}, row binary, n_words long, text string")
    return arrow_map(rows.join(found.hint("merge"), "row", "left").select("doc_id", "n_words", F.when(F.col("spans").isNotNull(), F.col("text")).alias("text"), "spans", "items"), whole, f"doc_id {kind}, n_words long, {_FOUND}, hit_spans string")


def judged(found: DataFrame) -> DataFrame:
    """found with n_hit, n_items, items_sha256 and contaminated: some hit, and at least a twentieth of the words."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    return found.withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)}).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans for every row of docs, as hits() says.
    Repeated rows each get a row; item ids repeat as one; an empty items table makes nothing contaminated, and an empty
    docs table gives an empty one; other columns are not read."""
    return judged(hits(docs, items)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans")


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as code-point spans of the original text."""
    where = word_spans(text)
    return [(where[a][0], where[b - 1][1]) for a, b in spans]


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no window of any item, with docs' columns. A long document goes for one passage too:
    its share of the words does not matter. Null and empty texts stay, as do all where no item has words. Repeated rows
    stay or go together."""
    blocks = item_blocks(items)
    for k, block in enumerate(blocks):
        get, rows = _matcher(block)
        docs = arrow_filter(docs, "text", lambda texts, get=get: [not get().find(normal_words(t)) for t in texts])
        if k + 1 < len(blocks):
            docs = keep(docs, "clean")
            rows.unpersist()
    return docs

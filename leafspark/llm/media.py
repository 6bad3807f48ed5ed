"""Media columns by content-defined payload chunking.

A payload is cut where a rolling gear hash of its last 32 bytes has given bits zero. Chunks are named by their digests
and each distinct chunk is stored once; a recipe, the ordered list of digests, reconstructs a payload, which is verified
chunk by chunk and as a whole.

Copies of a payload are found by digest before anything is moved. A join on chunk digests then gives every chunk an
owner, the least payload that holds it. The store has a record for each distinct payload: MAGIC, a header, the recipe
(of each chunk its digest, length, and whether the payload owns it and others need it), and the owned chunks, bz2.
Payloads are moved once, compressed, to be stored; on reading, only chunks owned elsewhere move.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.llm.common import arrow_map, keep, release, text_bytes

FRAME, PAD = 576, b"\xff"
LEAST, MOST, CUT_BITS = 512, 8192, 11
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)
_CUT = np.uint32(((1 << CUT_BITS) - 1) << (32 - CUT_BITS))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text as UTF-8 with bytes 255 up to a positive multiple of FRAME, and the length without them."""
    raw = text_bytes(text)
    return raw + PAD * (-len(raw) % FRAME or FRAME * (not raw)), len(raw)


def gear_hashes(payload: bytes) -> np.ndarray:
    """The gear hash h = 2 h + GEAR[byte] after each byte, mod 2^32, for all bytes at once: sums over 1, 2, 4, 8, 16 and
    32 last bytes by doubling."""
    h = GEAR[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cut(payload: bytes) -> list[int]:
    """Ends of the chunks: at cut points LEAST to MOST bytes after the last one, else after MOST bytes."""
    points = np.flatnonzero((gear_hashes(payload) & _CUT) == 0) + 1
    ends, at, n = [], 0, len(payload)
    while at < n:
        k = int(np.searchsorted(points, at + LEAST))
        at = min(int(points[k]) if k < len(points) and points[k] <= at + MOST else at + MOST, n)
        ends.append(at)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def chunks(payload: bytes) -> list[bytes]:
    ends = cut(payload)
    return [payload[a:b] for a, b in zip([0, *ends], ends)]


def _describe(ids, texts):
    names, sizes, lengths, recipes = [], [], [], []
    for text in texts:
        payload, n = payload_of(text)
        names.append(digest(payload))
        sizes.append(n)
        lengths.append(len(payload))
        recipes.append([digest(c) for c in chunks(payload)])
    return [ids, names, sizes, lengths, recipes]


def _pack(texts):
    names, packed = [], []
    for text in texts:
        payload, n = payload_of(text)
        names.append(digest(payload))
        packed.append(bz2.compress(payload[:n]))
    return [names, packed]


def _padded(raw: bytes) -> bytes:
    return raw + PAD * (-len(raw) % FRAME or FRAME * (not raw))


MAGIC, _HEAD, _CHUNK = b"LCDC", struct.Struct("<QIB"), struct.Struct("<16sIB")
OWNED, LENT = 1, 2


def record(n_bytes: int, parts: list[bytes], owned: set[int], lent: set[int], packed: bytes | None) -> bytes:
    """The stored form of a payload of these chunks. With packed (its bytes without padding, bz2) all chunks are its own."""
    out = [MAGIC, _HEAD.pack(n_bytes, len(parts), packed is not None)]
    out += [_CHUNK.pack(digest(p), len(p), OWNED * (k in owned) | LENT * (k in lent)) for k, p in enumerate(parts)]
    return b"".join([*out, bz2.compress(b"".join(parts[k] for k in sorted(owned))) if packed is None else packed])


class Record:
    """A stored record: n_bytes, chunks (digest, length, flags) in order, and the bytes of those that it owns."""

    def __init__(self, stored: bytes):
        if stored[:4] != MAGIC:
            raise ValueError("not a stored payload")
        self.n_bytes, n, whole = _HEAD.unpack_from(stored, 4)
        body = 4 + _HEAD.size + n * _CHUNK.size
        self.chunks = list(_CHUNK.iter_unpack(stored[4 + _HEAD.size : body]))
        raw = bz2.decompress(stored[body:])
        self.owned, at, raw = {}, 0, _padded(raw) if whole else raw
        for name, length, flags in self.chunks:
            if flags & OWNED:
                self.owned[name] = raw[at : at + length]
                at += length


def _store(names, packed, owned, shared):
    stored, lends, borrows = [], [], []
    for z, own, lent in zip(packed, owned, shared):
        raw, own = bz2.decompress(z), set(own or [])
        parts = chunks(_padded(raw))
        # A payload that owns all its chunks is stored as it came, without the padding.
        stored.append(record(len(raw), parts, own, set(lent or []), z if len(own) == len(parts) else None))
        have = {digest(parts[k]) for k in own}
        lends.append(bool(lent))
        borrows.append(sorted({digest(p) for k, p in enumerate(parts) if k not in own} - have))
    return [names, stored, lends, borrows]


def _lend(stored):
    """digest, bytes of the chunks that payloads own and others need too."""
    names, blobs = [], []
    for s in stored:
        found = Record(s)
        for name, _, flags in found.chunks:
            if flags & LENT:
                names.append(name)
                blobs.append(zlib.compress(found.owned[name], 6))
    return [names, blobs]


def features(payload: bytes) -> str:
    """Mean, standard deviation, sign changes about the middle and entropy (bits) of the 8-bit samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values, n = np.arange(256), len(x)
    mean = int((counts * values).sum()) / n
    spread = max(0.0, int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"samples={n};mean={mean:.6f};std={spread:.6f};turns={turns};entropy={float(-(p * np.log2(p)).sum()):.6f}"


def _read(names, stored, borrowed):
    out = [[] for _ in range(9)]
    for name, s, lent in zip(names, stored, borrowed):
        found = Record(s)
        have = {x["name"]: zlib.decompress(x["blob"]) for x in lent or []} | found.owned
        parts = [have.get(d, b"") for d, _, _ in found.chunks]
        payload = b"".join(parts)
        if digest(payload) != name or any(digest(p) != d or len(p) != n for p, (d, n, _) in zip(parts, found.chunks)):
            raise ValueError(f"the stored chunks of payload {name.hex()} do not match their digests")
        row = (name, found.n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(s), hashlib.sha256(s).hexdigest(), features(payload), len(parts))
        for column, value in zip(out, row):
            column.append(value)
    return out


def build_store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' payload names (doc_id, name), and the chunk store, both written to the shared folder."""
    listed = keep(arrow_map(docs.select("doc_id", "text"), _describe, "doc_id long, name binary, n_bytes long, payload_bytes long, recipe array<binary>"), "recipes")
    once = listed.groupBy("name").agg(F.first("recipe").alias("recipe"))
    holds = once.select("name", F.posexplode("recipe").alias("k", "chunk"))
    owners = holds.groupBy("chunk").agg(F.min(F.struct("name", "k")).alias("o"), F.count("*").alias("n"))
    mine = owners.groupBy(F.col("o.name").alias("name")).agg(F.collect_list("o.k").alias("owned"), F.collect_list(F.when(F.col("n") > 1, F.col("o.k"))).alias("shared"))
    # What found the owners goes before the payloads come.
    mine = keep(mine, "owned")
    del once, holds, owners
    release(docs.sparkSession)
    bodies = arrow_map(docs.select("text"), _pack, "name binary, z binary").groupBy("name").agg(F.first("z").alias("z"))
    store = arrow_map(
        bodies.join(mine.hint("merge"), "name", "left").select("name", "z", "owned", "shared"),
        _store,
        "name binary, stored binary, lends boolean, borrows array<binary>",
    )
    return listed.select("doc_id", "name"), keep(store, "chunks")


def read_store(store: DataFrame) -> DataFrame:
    """Every payload of the store, reconstructed from its chunks, verified, and described."""
    lent = arrow_map(store.where("lends").select("stored"), _lend, "chunk binary, blob binary")
    needs = store.where(F.size("borrows") > 0).select("name", F.explode("borrows").alias("chunk"))
    got = needs.join(lent, "chunk").groupBy("name").agg(F.collect_list(F.struct(F.col("chunk").alias("name"), "blob")).alias("borrowed"))
    kind = "array<struct<name: binary, blob: binary>>"
    whole = store.where(F.size("borrows") == 0).select("name", "stored", F.lit(None).cast(kind).alias("borrowed"))
    parts = store.where(F.size("borrows") > 0).select("name", "stored").join(got, "name").select("name", "stored", F.col("borrowed").cast(kind).alias("borrowed"))
    return arrow_map(
        whole.union(parts),
        _read,
        "name binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long",
    )


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks for every
    row of docs(doc_id, text, ...), from the stored bytes as read back.

    media_bytes and media_sha256 are of the payload's record as it is stored: its recipe, and the chunks that it owns. A
    null text is an empty one, whose
    payload is one frame of padding. Equal texts, repeated rows and rows without a doc_id have equal values; an empty
    table gives an empty one; other columns are not read.
    """
    listed, store = build_store(docs)
    release(docs.sparkSession)
    return listed.join(read_store(store), "name").drop("name").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")

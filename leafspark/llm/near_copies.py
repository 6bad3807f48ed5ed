"""One document of each group of near copies, by the similarity of their sets of shingles.

Two documents are near copies if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more; groups are the
connected components. All candidates are checked on their whole sets, and come in two ways:

- by SimHash and the generalised pigeonhole principle (simhash.within): 64-bit fingerprints of the sets within RADIUS bits; of a
  crowded bucket of fingerprints only those with the least member;
- as two sets alike to 0.8 may differ by more bits than any radius that can be searched (their mean is 10 bits): by a shared
  band of ROWS of BANDS x ROWS min-hashes. A pair at 0.8 is missed with odds of (1 - 0.8^6)^52, 1.4e-7.

In a bucket, all members are checked against the least one first, and after that only pairs that are not yet connected:
each has a member that is not connected to the least. In a crowded bucket these could still be as many as the square of
its members. So crowded buckets that share members are taken together as a family; a member whose shingles are too
often in no other member cannot be similar to any, and is left out; the others are dealt into blocks of a bounded size,
and each two blocks are checked as a whole, by a product of matrices. What is shuffled is a set for each two blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafspark.llm.common import arrow_map, components, keep, text_bytes
from leafspark.llm.simhash import LOWER, majority, only, within

SHINGLE, BANDS, ROWS = 5, 52, 6
#: Bits by which fingerprints of candidates differ at most, partitions of their bits, and members beyond which a bucket
#: of fingerprints is crowded.
RADIUS, PARTS, MEET = 8, 3, 8
#: Members of a bucket beyond which it is crowded; members of a block, and shingles in it, about.
CROWD, BLOCK, BLOCK_SHINGLES = 64, 128, 1 << 18
#: The least similarity, as a fraction.
SIMILAR, OF = 4, 5
_BLOCK = 1024
_ODD = np.random.default_rng(4).integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
_KEYS = np.random.default_rng(5).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32) | np.array([[[0]], [[1]]], np.uint32)
_JOIN = np.random.default_rng(6).integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of SHINGLE words, A-Z in lower case, or of all words if fewer."""
    words = text_bytes(text).translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n, digest = min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    x = np.fromiter([digest(w, n) for w in words], np.uint64, len(words))
    return np.unique(_mix((np.lib.stride_tricks.sliding_window_view(x, n) * _ODD[:n]).sum(axis=1, dtype=np.uint64)))


def bands(found: np.ndarray) -> list[int]:
    """A hash of each band of the set's min-hashes; of the empty set there are none."""
    if not len(found):
        return []
    least, high = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), _BLOCK):
        np.minimum(least, ((high[at : at + _BLOCK] ^ _KEYS[0]) * _KEYS[1]).min(axis=1), out=least)
    return _mix((least.reshape(BANDS, ROWS) * _JOIN).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _JOIN[0]).view(np.int64).tolist()


def _sketch(ids, texts):
    sets = [shingles(t) for t in texts]
    return [ids, [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [bands(s) for s in sets], [majority(s) for s in sets], [len(s) for s in sets]]


def _similar(a, b, ones, others):
    out = [[], []]
    for x, y, one, other in zip(a, b, ones, others):
        one, other = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
        both = len(np.intersect1d(one, other, assume_unique=True))
        if OF * both >= SIMILAR * (len(one) + len(other) - both):
            out[0].append(x)
            out[1].append(y)
    return out


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("one")).hint("merge"), "a")
    met = met.join(sets.select(F.col("node").alias("b"), F.col("set").alias("other")).hint("merge"), "b")
    return keep(arrow_map(met.select("a", "b", "one", "other"), _similar, "a long, b long"), "similar")


def _spelled(nodes, sets):
    found = [np.frombuffer(s, np.int64) for s in sets]
    return [np.repeat(np.array(nodes, np.int64), [len(f) for f in found]), np.concatenate(found) if found else []]


def _common(members: DataFrame, sets: DataFrame) -> DataFrame:
    """node and how many of its shingles any other of the members has."""
    spelled = arrow_map(sets.join(members.select("node").hint("merge"), "node", "left_semi").select("node", "set"), _spelled, "node long, s long")
    alone = spelled.groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1").groupBy("node").agg(F.count("*").alias("alone"))
    return members.join(alone.hint("merge"), "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def alike(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Which sets are similar enough to which, by the sizes of their intersections: columns of shingles, some at a time."""
    sizes = np.array([len(s) for s in sets])
    values, n = np.unique(np.concatenate(sets), return_counts=True)
    values = values[n > 1]
    both = np.zeros((len(sets), len(sets)))
    for at in range(0, len(values), width):
        part = values[at : at + width]
        has = np.stack([np.isin(part, s, assume_unique=True) for s in sets]).astype(np.float32)
        both += has @ has.T
    return OF * both >= SIMILAR * (sizes[:, None] + sizes[None, :] - both)


def _block_pairs(table: pa.Table) -> pa.Table:
    """Of the members of one or two blocks, links between those that are not connected yet: enough to connect them."""
    nodes, roots, sides = (table.column(c).to_numpy() for c in ("node", "c", "side"))
    out: list[tuple[int, int]] = []
    if len(set(roots.tolist())) > 1:
        alone = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        linked = alike([np.frombuffer(s, np.uint64) for s in table.column("set").to_pylist()])
        linked &= roots[:, None] != roots[None, :]
        linked &= np.triu(np.ones_like(linked)) if alone else sides[:, None] < sides[None, :]
        above = {r: r for r in roots.tolist()}

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        for i, k in zip(*(x.tolist() for x in np.nonzero(linked))):
            one, other = top(roots[i].item()), top(roots[k].item())
            if one != other:
                above[one] = other
                out.append((min(nodes[i], nodes[k]), max(nodes[i], nodes[k])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _crowded(crowds: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of crowded buckets (h, node, size, lead) of different components."""
    members = keep(crowds.select("node", "size").distinct(), "members")
    family = components(crowds.where("lead < node").select(F.col("node").alias("a"), F.col("lead").alias("b")))
    able = _common(members, sets).where(F.col("common") * OF >= F.col("size") * SIMILAR)
    named = able.join(family.select("node", F.col("root").alias("family")).hint("merge"), "node").join(roots.select("node", "root").hint("merge"), "node", "left")
    named = keep(named.select("node", "size", "family", F.coalesce("root", "node").alias("c")), "families")
    n = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    open_ = named.groupBy("family").agg(n.alias("blocks"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("family", "blocks")
    dealt = named.join(open_, "family").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.join(sets.hint("merge"), "node").select("family", "node", "c", "side", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = dealt.select("family", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "node", "c", "side", "set")
    return pairs.groupBy("family", "lo", "hi").applyInArrow(_block_pairs, "a long, b long")


def groups(docs: DataFrame, sketch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the distinct sets the least doc_id (node), and (node, root) of those that are in a group of several."""
    distinct = keep(sketch.groupBy("key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.first("size").alias("size")), "distinct")
    members = distinct.select("node", "size", F.explode("bands").alias("h"))
    lead = members.groupBy("h").agg(F.min("node").alias("lead"), F.max("node").alias("most"), F.count("*").alias("n")).where("lead < most").select("h", "lead", (F.col("n") > CROWD).alias("crowded"))
    buckets = keep(members.join(lead.hint("merge"), "h").select("h", "node", "size", "lead", "crowded"), "buckets")
    near = keep(within(distinct.where("size > 0").select("node", "fp"), RADIUS, PARTS, MEET), "near")
    nodes = buckets.select("node").union(near.select("a")).union(near.select("b")).distinct()
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(nodes.hint("merge"), "node", "left_semi")
    sets = keep(arrow_map(texts, lambda ids, ts: [ids, [shingles(t).tobytes() for t in ts]], "node long, set binary").dropDuplicates(["node"]), "sets")

    stars = keep(buckets.where("lead < node").select(F.col("lead").alias("a"), F.col("node").alias("b")).union(near).distinct(), "stars")
    good = _checked(stars, sets)
    roots = keep(components(good), "roots")
    of = lambda c, to: roots.select(F.col("node").alias(c), F.col("root").alias(to))
    calm = buckets.where("not crowded")
    named = calm.join(of("node", "c").hint("merge"), "node", "left").join(of("lead", "d").hint("merge"), "lead", "left")
    named = keep(named.select("h", "node", "size", F.coalesce("c", "node").alias("c"), F.coalesce("d", "lead").alias("d")), "named")
    apart = named.where("c <> d").select("h", F.col("node").alias("other"), F.col("c").alias("e"), F.col("size").alias("others"))
    # The smaller set is at most all that both have, the larger one at least all that either has.
    can = F.least("size", "others") * OF >= F.greatest("size", "others") * SIMILAR
    pairs = named.select("h", "node", "size", "c").join(apart.hint("merge"), "h").where("c <> e").where(can).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    more = _checked(pairs.join(stars.hint("merge"), ["a", "b"], "left_anti"), sets)
    crowds = buckets.where("crowded")
    if not crowds.isEmpty():
        more = more.union(keep(_crowded(crowds, roots, sets), "crowded"))
    if not more.isEmpty():
        roots = components(good.union(more))
    return distinct.select("node"), roots


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that have a smaller doc_id in their group, with docs' columns, whatever they are named. Null
    and empty texts are alike; very long ones are taken whole. Rows of one doc_id are one document, of which the repeats
    go; rows without a doc_id stay. An empty table stays empty."""
    named = docs.where("doc_id is not null")
    sketch = keep(arrow_map(named.select("doc_id", "text"), _sketch, "doc_id long, key binary, bands array<long>, fp long, size int"), "sketches")
    distinct, roots = groups(named, sketch)
    firsts = distinct.distinct().join(roots.where("node <> root").select("node").hint("merge"), "node", "left_anti")
    return only(docs, firsts.select(F.col("node").alias("doc_id")), sketch.select("doc_id"))

"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at a distance of RADIUS bits or less. The bits are grouped into partitions of correlated
bits; dynamic programming on estimated candidate counts gives each partition its own threshold (-1: not probed), with a
sum of RADIUS - partitions + 1, so that each linked pair agrees within the threshold in some probed partition. Probes
find candidates, which are verified on all bits.

A crowded bucket would give pairs by the square of its members. There, each member sends itself to its 65 neighbours
within one bit instead: two fingerprints within two bits of each other meet at a neighbour of both, where the least
member links to all others. That is exact, and linear in the members.

That is within(), too, for any radius, of whose thresholds both fingerprints step half.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafspark.llm.common import arrow_map, components, hex16, keep, small_batches, text_bytes

RADIUS, BITS, SEED, SHINGLE = 2, 64, 42, 3
#: Members of a bucket beyond which its pairs are found by way of neighbours.
CROWD = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The SimHash of whole text, as a signed long: words at ASCII white space, 3-word shingles with repeats."""
    words = text_bytes(text).translate(LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b"%s %s %s".__mod__, zip(words, words[1:], words[2:])))
    n, counts = len(shingles), np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        h = np.array([digest(s, SEED) for s in shingles[at : at + _BLOCK]], ">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def majority(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes, as a signed long: the bits that over half of them have; zero of none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp of every row; a null or empty text has fingerprint zero."""
    return arrow_map(docs.select("doc_id", "text"), lambda ids, texts: [ids, [fingerprint(t) for t in texts]], "doc_id long, fp long")


def bit_pairs(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how many of them have both bits set, for each two bits, over all rows."""
    small_batches(distinct.sparkSession)

    def count(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(">i8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += bits.T @ bits
            n += len(h)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_pydict({"i": pa.array([-1, *i], pa.int32()), "j": pa.array([-1, *j], pa.int32()), "c": pa.array([n, *total[i, j].astype(np.int64)], pa.int64())})

    rows = distinct.mapInArrow(count, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()  # 2,081 rows
    both, n = np.zeros((BITS, BITS)), 0
    for i, j, c in rows:
        if i < 0:
            n = c
        else:
            both[i, j] = both[j, i] = c
    return n, both


def partitions(n: int, both: np.ndarray, m: int | None = None) -> list[list[int]]:
    """m groups of bits (0: the highest), or as many as keep a bucket of random fingerprints near one member, each group
    grown from the bit most correlated with the rest by the bit most correlated with the group."""
    m = m or next((m for m in (4, 3) if n < 2 ** (BITS // m)), 2)
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, groups = list(range(BITS)), []
    for k in range(m, 0, -1):
        group = [max(left, key=lambda b: (tie[b, left].sum(), -b))]
        left.remove(group[0])
        for _ in range(math.ceil((len(left) + 1) / k) - 1):
            group.append(max(left, key=lambda b: (tie[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def thresholds(n: int, both: np.ndarray, groups: list[list[int]], collisions: list[int], radius: int = RADIUS, halves: bool = False) -> list[int]:
    """The thresholds of least estimated cost whose sum is radius - partitions + 1.

    The cost of a threshold is its probes, and the candidates that they meet: the counted pairs of equal values, times
    for each further differing bits the odds that two fingerprints differ there. With halves, probes are those of half
    the threshold, rounded up."""
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p * p + (1 - p) ** 2, 0.5, 1 - 1e-9)
    odds = (1 - agree) / agree

    def met(k: int, most: int) -> float:
        sums = np.ones(1)
        for o in odds[groups[k]]:
            sums = np.convolve(sums, [1.0, o])
        return float(sums[: most + 1].sum())

    def cost(k: int, t: int) -> float:
        if halves:
            steps = (t + 1) // 2
            return 0.0 if t < 0 else n * sum(math.comb(len(groups[k]), d) for d in range(steps + 1)) + collisions[k] * met(k, 2 * steps)
        ratios = [1.0] + [sum(math.prod(c) for c in combinations(odds[groups[k]], d)) for d in range(1, t + 1)]
        return sum(n * math.comb(len(groups[k]), d) + collisions[k] * ratios[d] for d in range(t + 1))

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for k in range(len(groups)):
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(-1, radius + 1):
                option = (c + cost(k, t), [*chosen, t])
                if used + t not in new or option < new[used + t]:
                    new[used + t] = option
        best = new
    return best[radius - len(groups) + 1][1]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _mask(bits) -> int:
    return _signed(sum(1 << (BITS - 1 - b) for b in bits))


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect all fingerprints fp of distinct within RADIUS bits; between members of a crowded
    bucket only so many that what is linked stays connected."""
    n, both = bit_pairs(distinct)
    groups = partitions(n, both)
    masks = [_mask(g) for g in groups]
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("val")) for k, m in enumerate(masks))))
    index = distinct.select("fp", values.alias("v")).select("v.part", "v.val", "fp")
    sizes = keep(index.groupBy("part", "val").count().where("count > 1"), "buckets")
    seen = {r["part"]: int(r["c"]) for r in sizes.groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1)).alias("c")).collect()}
    chosen = thresholds(n, both, groups, [seen.get(k, 0) for k in range(len(groups))])
    probed = [(k, t) for k, t in enumerate(chosen) if t >= 0]
    flips = [F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseXOR(F.lit(_mask(c))).bitwiseAND(F.lit(masks[k])).alias("val")) for k, t in probed for d in range(t + 1) for c in combinations(groups[k], d)]
    probes = distinct.select("fp", F.explode(F.array(*flips)).alias("v")).select("v.part", "v.val", "fp")
    crowded = sizes.where(F.col("count") > crowd).select("part", "val")
    calm = index.join(crowded, ["part", "val"], "left_anti").select("part", "val", F.col("fp").alias("other"))
    if not crowded.isEmpty():  # many probes may meet at one value: Spark can split them if the other side is a table
        calm = keep(calm, "calm")
    pairs = probes.join(calm, ["part", "val"]).where((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if crowded.isEmpty():
        return pairs
    members = probes.join(crowded, ["part", "val"], "left_semi").select("fp").distinct()
    # RADIUS is one step from either side.
    near = F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_mask([b]))) for b in range(BITS))))
    meet = members.select("fp", near.alias("at")).groupBy("at").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    stars = meet.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.union(stars)


def within(marks: DataFrame, radius: int, m: int, crowd: int = CROWD) -> DataFrame:
    """The pairs (a, b), a < b, of the nodes of marks(node, fp), each there once, whose fingerprints are within radius
    bits; of a bucket of more than crowd members only those with its least node.

    Of m partitions, each fingerprint goes to the values within half the threshold: two that are within the threshold
    meet at one of them, for far fewer rows than if one of them took all the steps."""
    n, both = bit_pairs(marks.select("fp"))
    groups = partitions(n, both, m)
    masks = [_mask(g) for g in groups]
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(x)).alias("val")) for k, x in enumerate(masks))))
    sizes = marks.select(values.alias("v")).groupBy("v.part", "v.val").count()
    seen = {r["part"]: int(r["c"]) for r in sizes.groupBy("part").agg(F.sum(F.col("count") * (F.col("count") - 1)).alias("c")).collect()}
    chosen = thresholds(n, both, groups, [seen.get(k, 0) for k in range(m)], radius, halves=True)
    turns = [(k, _mask(c)) for k, t in enumerate(chosen) if t >= 0 for d in range((t + 1) // 2 + 1) for c in combinations(groups[k], d)]
    places = F.array(*(F.struct(F.xxhash64(F.lit(k), F.col("fp").bitwiseXOR(F.lit(x)).bitwiseAND(F.lit(masks[k]))).alias("h"), F.lit(x).cast("long").alias("turned")) for k, x in turns))
    bucket = Window.partitionBy("h")
    met = marks.select("node", "fp", F.explode(places).alias("p")).select("p.h", "p.turned", "node", "fp")
    met = met.select("*", F.count("*").over(bucket).alias("n"), F.min("node").over(bucket).alias("lead"), F.min_by("fp", "node").over(bucket).alias("first")).where("n > 1")
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= radius
    one, other = (met.where(F.col("n") <= crowd).select("h", F.col("node").alias(a), F.col("fp").alias(f"fp_{a}"), F.col("turned").alias(f"turned_{a}")) for a in "ab")
    # Two that differ by some bits meet where the one has turned x and the other y, and where it is the other way round.
    once = (F.col("turned_a") < F.col("turned_b")) | ((F.col("turned_a") == 0) & (F.col("turned_b") == 0))
    pairs = one.hint("merge").join(other, "h").where((F.col("a") < F.col("b")) & once & near("fp_a", "fp_b")).select("a", "b")
    stars = met.where((F.col("n") > crowd) & (F.col("lead") < F.col("node")) & near("fp", "first")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs(doc_id, text, ...).

    A null text is an empty one; empty texts have fingerprint zero and link like any other; very long ones are read whole.
    Repeated rows each get a
    row. A null doc_id never names a component; a component of such rows alone has a null component_id. An empty table
    gives an empty one. Other columns are not read.
    """
    marks = keep(fingerprints(docs), "fingerprints")
    distinct = keep(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp")))
    # Of every fingerprint: the least doc_id of its component.
    named = roots.join(distinct, roots["node"] == distinct["fp"]).select("node", "root", "first")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    better = named.join(least, "root").select(F.col("node").alias("fp"), "least")
    # Kept, so that Spark can split the join for a fingerprint that very many rows have.
    answer = keep(distinct.join(better, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "answer")
    return marks.join(answer.hint("merge"), "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def only(docs: DataFrame, firsts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in firsts, one for each doc_id, and those without a doc_id. ids has the doc_id
    of every row."""
    # The ids kept grow with the input, so both sides are shuffled at any size.
    named = docs.join(firsts.hint("merge"), "doc_id", "left_semi")
    repeated = ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.isEmpty():
        named = named.join(repeated, "doc_id", "left_anti").unionByName(named.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return named.select(*(f"`{c}`" for c in docs.columns)).unionByName(docs.where("doc_id is null"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the rows that have a smaller doc_id in their component. Rows of one doc_id are one document, of
    which the repeats go; rows without a doc_id stay."""
    found = keep(near_duplicates(docs), "components")
    firsts = found.where("doc_id = component_id").select("doc_id").distinct()
    return only(docs, firsts, found.select("doc_id"))

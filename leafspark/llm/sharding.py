"""Sharding by a hierarchical weighted hash tree, in DataFrame functions alone.

Shards hang on racks, racks on regions. At each level a row draws -ln(u) / weight for each child of its node, with u
from a hash of its id and the child, and descends to the least draw: a child is chosen in proportion to its weight, and
a change of weights moves rows only into or out of subtrees whose weights changed. Shards beyond the first `base` are
regions of their own, so that one more shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafspark.llm.common import keep

SHARDS, RACKS, PER_RACK = 16, 2, 2
#: Parts of a shard that are numbered side by side.
PARTS = 256


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def layout(shards: int, base: int = SHARDS, racks: int = RACKS, per_rack: int = PER_RACK) -> list[Shard]:
    """Shards 0 to shards - 1: the first `base` in regions of `racks` racks of `per_rack`, each further one a region."""
    out = []
    for s in range(shards):
        if s < base:
            out.append(Shard(f"region {s // (racks * per_rack)}", f"rack {s // per_rack}", s))
        else:
            out.append(Shard(f"region of {s}", f"rack of {s}", s))
    return out


def _draw(key: Column, child: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(child), key), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def _choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw; the earlier of equal ones."""
    if len(children) == 1:
        return children[0][2]
    least = F.array_min(F.array(*(F.struct(_draw(key, name, w).alias("draw"), F.lit(k).alias("k")) for k, (name, w, _) in enumerate(children))))["k"]
    return F.element_at(F.array(*(value for _, _, value in children)), least + 1)


def descend(key: Column, tree: list[Shard]) -> Column:
    """The shard (int) of a row with this key. Subtrees without weight take no rows."""
    tree = [s for s in tree if s.weight > 0]
    if not tree:
        raise ValueError("no shard has a weight")
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in tree:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)

    def rack(name: str, shards: list[Shard]) -> Column:
        return _choose(key, [(f"{name}/{s.shard}", s.weight, F.lit(s.shard)) for s in shards])

    def region(name: str, racks: dict[str, list[Shard]]) -> Column:
        return _choose(key, [(f"{name}/{r}", sum(s.weight for s in shards), rack(f"{name}/{r}", shards)) for r, shards in racks.items()])

    return _choose(key, [(name, sum(s.weight for shards in racks.values() for s in shards), region(name, racks)) for name, racks in regions.items()])


def shard_documents(docs: DataFrame, shards: int = SHARDS, base: int = SHARDS, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs(doc_id, text, ...).

    size is the text's UTF-8 bytes plus one. Shards follow from doc_id and the number of shards alone (law "key");
    grown_shard is the shard with one more. Slots number a shard's rows from 0 without gaps: by part (a hash of the
    row), within it by doc_id, checksum and size. A null text counts as an empty one; rows without a doc_id share one
    shard; repeated rows share their shard and have slots of their own. An empty table gives an empty one; other
    columns are not read. Exact copies of texts are rows like others: their number changes nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id").cast("long")
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        descend(key, layout(shards, base)).alias("shard"),
        descend(key, layout(shards + 1, base)).alias("grown_shard"),
    )
    placed = keep(placed.withColumn("_part", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(parts)).cast("int")), "placed")
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("n"))  # shards x parts rows at most
    before = counts.select("shard", "_part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        placed.withColumn("within", within)
        .join(F.broadcast(before), ["shard", "_part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), "grown_shard")
    )

"""Sharding by a hierarchical weighted hash tree, with DataFrame functions alone.

A tree has regions, regions have racks, racks have shards, and every shard has a weight; a rack's or region's weight is
the sum of what it holds. A document descends level by level. At each node the children draw -ln(u) / weight, where u in
(0, 1) comes from a hash of the document and the child's name, and the smallest draw wins. A draw depends on nothing but
the document, the child and the child's weight, so after a change of weights documents move only into subtrees whose
weight grew and out of those whose weight shrank.

``layout(n)`` gives the first 16 shards two regions of two racks of four shards. Each further shard opens a region of its
own, so one more shard takes documents only into itself.

Defined results: a null text has no bytes (size 1, crc32 of nothing); a null doc_id is hashed as the word "null";
repeated rows get the same shard and slots of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (region, rack, shard, weight)
Tree = list[tuple[int, int, int, float]]
#: Groups of a shard for numbering its rows; a group is one task's work.
BLOCKS = 4096


def layout(shards: int, regions: int = 2, racks: int = 2, per_rack: int = 4, weights: dict[int, float] | None = None) -> Tree:
    base = regions * racks * per_rack
    tree = []
    for s in range(shards):
        place = (s // (racks * per_rack), s // per_rack % racks) if s < base else (regions + s - base, 0)
        tree.append((*place, s, (weights or {}).get(s, 1.0)))
    return tree


def _draw(key: Column, name: str, weight: float) -> Column:
    # the upper 52 bits of the hash, in (0, 1)
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def _choose(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """What belongs to the child with the smallest draw; of equal draws the first."""
    live = [c for c in children if c[1] > 0]
    if len(live) == 1:
        return live[0][2]
    draws = [_draw(key, name, weight) for name, weight, _ in live]
    least = F.least(*draws)
    chosen = F.lit(None).cast("int")
    for draw, (_, _, value) in reversed(list(zip(draws, live))):
        chosen = F.when(draw == least, value).otherwise(chosen)
    return chosen


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key. key is hashed as text, so that numbers of any width give the same shard."""
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def weight(rows: Tree) -> float:
        return sum(r[3] for r in rows)

    regions = []
    for region in sorted({r[0] for r in tree}):
        inside = [r for r in tree if r[0] == region]
        racks = []
        for rack in sorted({r[1] for r in inside}):
            rows = [r for r in inside if r[1] == rack]
            leaf = _choose(key, [(f"shard {r[2]}", r[3], F.lit(r[2])) for r in rows])
            racks.append((f"rack {region}.{rack}", weight(rows), leaf))
        regions.append((f"region {region}", weight(inside), _choose(key, racks)))
    return _choose(key, regions)


def assign(docs: DataFrame, tree: Tree, grown: Tree, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard in the tree ``grown``).

    Slots number a shard's rows without gaps: rows are numbered inside groups given by a hash of doc_id and text, and groups
    start where prefix sums over their sizes say. Texts are read once and not shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.col("doc_id")
    # of the text too, so that rows that share a doc_id, or have none, are many groups
    block = F.pmod(F.xxhash64(key.cast("string"), F.crc32(text), F.lit("slot")), F.lit(blocks)).cast("int").alias("_block")
    rows = docs.select(
        key.cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, grown).alias("grown_shard"),
        block,
    )
    inside = Window.partitionBy("shard", "_block").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("_k", F.row_number().over(inside) - 1)
    sizes = docs.select(shard_of(key, tree).alias("shard"), block)
    sizes = sizes.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = numbered.join(bases, ["shard", "_block"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_base") + F.col("_k")).alias("slot"), "grown_shard")

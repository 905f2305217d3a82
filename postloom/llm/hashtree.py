"""Sharding by a weighted hash tree: region, then rack, then shard.

At each level a row draws -ln(u) / weight for every child of the node it is in, with u from a hash of
its id and the child, and goes to the smallest draw. A child's draw depends on its own weight only, so
a change of weight moves rows between that child and its siblings and nowhere else: movement stays in
the subtrees whose weights change. A new region takes rows only into itself.

Everything is built-in expressions; the tree is a few literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Shards to a rack and racks to a region in a tree made from a shard count.
RACK, REGION = 2, 2
#: Cells of a shard for numbering its rows; each is one small window.
CELLS = 4096


@dataclass(frozen=True)
class Leaf:
    """A shard and where it stands."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, built: int = 8) -> list[Leaf]:
    """``shards`` shards of equal weight: the first ``built`` rack by rack and region by region, each later one alone.

    A shard added to a region would make it heavier and move rows to its neighbours as well; a region of its own takes
    rows only into itself, however many have been added before. ``built`` is a number of whole regions.
    """
    full = RACK * REGION
    return [
        Leaf(s // full, s // RACK, s) if s < built else Leaf(built // full + s - built, built // RACK + s - built, s)
        for s in range(shards)
    ]


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    # the upper 52 bits of the hash, in the middle of their step: never 0, never 1
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def _smallest(draws: dict[int, Column]) -> Column:
    """The node of the smallest draw; of equal draws the lowest node."""
    if len(draws) == 1:
        return F.lit(next(iter(draws)))
    ranked = F.array(*[F.struct(draw.alias("draw"), F.lit(node).alias("node")) for node, draw in sorted(draws.items())])
    return F.array_min(ranked)["node"]


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key in the tree of ``leaves`` (weights above zero)."""
    live = [leaf for leaf in leaves if leaf.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")

    def weights(level: str, among: list[Leaf]) -> dict[int, float]:
        sums: dict[int, float] = {}
        for leaf in among:
            sums[getattr(leaf, level)] = sums.get(getattr(leaf, level), 0.0) + leaf.weight
        return sums

    def descend(levels: list[str], among: list[Leaf]) -> Column:
        level, *below = levels
        sums = weights(level, among)
        drawn = _smallest({node: _draw(key, level, node, w) for node, w in sums.items()})
        if not below:
            return drawn.cast("int")
        if len(sums) == 1:
            return descend(below, among)
        chosen = None
        for node in sums:
            inner = descend(below, [leaf for leaf in among if getattr(leaf, level) == node])
            chosen = F.when(drawn == node, inner) if chosen is None else chosen.when(drawn == node, inner)
        return chosen

    return descend(["region", "rack", "shard"], live)


def shard(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law`` (``key``), ``shard``,
    ``slot``, ``grown_shard`` (the shard in the tree ``grown``, or null without one).

    ``slot`` numbers a shard's rows from 0 without gaps, in the order of a hash of the id; rows with one
    id follow each other by checksum and size. Only ids and the trees decide, so any cluster gives the
    same shards. A null text counts as empty; rows with a null id share a shard. Repeated rows keep a slot each; an empty
    table gives no rows. Other columns of ``docs`` are ignored.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    key = docs["doc_id"].cast("long")
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )
    placed = rows.withColumn("shard", place(F.col("doc_id"), leaves)).withColumn(
        "grown_shard", (place(F.col("doc_id"), grown) if grown else F.lit(None)).cast("int")
    )
    order = F.xxhash64("doc_id", F.lit("slot"))
    dealt = placed.withColumn("order", order).withColumn(
        "cell", F.shiftrightunsigned("order", 64 - (CELLS.bit_length() - 1)).cast("int")
    )
    # rows before each cell: a table of at most CELLS rows for each shard
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "cell").orderBy("order", "doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("place", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(starts, ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.col("place")).alias("slot"),
        "grown_shard",
    )

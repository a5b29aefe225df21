"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import cut


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. The weight of an inner node is the sum below it."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = field(default=())

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree(shards: int, racks: int = 2, per_rack: int = 2, grown: int = 0) -> Node:
    """Regions of ``racks`` racks of ``per_rack`` shards, numbered from 0.

    Each of the ``grown`` further shards opens a region of its own. The other regions keep their
    weights, so a row either stays where it is or moves to the new region.
    """
    n = 0
    regions = []
    while n < shards:
        held = []
        for r in range(racks):
            take = min(per_rack, shards - n)
            if take:
                held.append(Node(f"g{len(regions)}/r{r}", children=tuple(Node(str(n + k)) for k in range(take))))
                n += take
        regions.append(Node(f"g{len(regions)}", children=tuple(held)))
    for k in range(grown):
        regions.append(Node(f"g+{k}", children=(Node(f"g+{k}/r0", children=(Node(str(shards + k)),)),)))
    return Node("root", children=tuple(regions))


def _draw(key: Column, node: Node) -> Column:
    """-ln(u) / weight with u in (0, 1] from the first 52 bits of md5(key|name): the least draw wins."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(node.name))), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 1) / F.lit(float(2**52))) / F.lit(node.total)


def place(key: Column, node: Node) -> Column:
    """The shard that ``key`` reaches: one weighted draw per level, among the children of the node above.

    A child's draw depends on the key, its name and its own weight only. When weights change in one
    subtree, rows move into or out of that subtree and nowhere else.
    """
    if not node.children:
        return F.lit(int(node.name))
    if len(node.children) == 1:
        return place(key, node.children[0])
    draws = F.array_sort(F.array(*(F.struct(_draw(key, c), F.lit(k)) for k, c in enumerate(node.children))))
    won = F.element_at(draws, 1)["col2"]
    out = F.when(won == 0, place(key, node.children[0]))
    for k, c in enumerate(node.children[1:], 1):
        out = out.when(won == k, place(key, c))
    return out


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    The id and the number of shards decide (law ``key``); a null id is a key like any other. Size is
    the UTF-8 bytes of the text plus 1 (null text: 1, checksum of the empty text). Slots count from 0
    in the order of id, size and checksum, without gaps, also where ids repeat. Other columns of
    ``docs`` are ignored, an empty table gives an empty one.

    Slots are found without one task per shard: rows are dealt by range of (shard, id, ...), which
    cuts also through a hot id, and counted per range; the ranges before give the offset.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        place(key, tree(shards)).alias("shard"),
        place(key, tree(shards, grown=1)).alias("grown"),
        F.monotonically_increasing_id().alias("nth"),
    )
    rows = cut(rows, "placed")
    order = ["id", "size", "crc", "nth"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, "shard", *order).withColumn("part", F.spark_partition_id()), "dealt")
    # A row for each shard and range: at most the number of ranges plus that of shards.
    counts = dealt.groupBy("shard", "part").count()
    offset = F.expr("sum(count) over (partition by shard order by part rows between unbounded preceding and 1 preceding)")
    offsets = counts.select("shard", "part", F.coalesce(offset, F.lit(0)).alias("offset"))
    nth = F.expr(f"row_number() over (partition by shard, part order by {', '.join(order)})")
    numbered = dealt.withColumn("nth_here", nth).join(offsets, ["shard", "part"])
    return numbered.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("nth_here") - 1).cast("long").alias("slot"), F.col("grown").alias("grown_shard"),
    )

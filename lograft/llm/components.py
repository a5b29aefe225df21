"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import cut, join_hot


def _both(links: DataFrame) -> DataFrame:
    """Each link from either end, with ``up``: 1 where it is seen from its larger node."""
    return links.select("u", "v", F.lit(1).alias("up")).unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("up")))


def _star(near: DataFrame, least: DataFrame, large: bool) -> DataFrame:
    """One kind of star from the neighbours of each node (u, v) and its least one (u, n, m).

    Large stars tie the larger neighbours of each node to its least neighbour, small stars tie the
    smaller ones and the node itself. Nodes with very many links, as the root of a large component
    has, meet theirs by broadcast.
    """
    tied = join_hot(near.select("u", "v"), least, "u")
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return cut(out.filter("u <> v").distinct(), "links")


def _stars(links: DataFrame, least: DataFrame) -> DataFrame:
    """One contraction of links (u > v), with ``least`` of their large stars.

    Minima and stars are written one by one: in one query, small stars would plan the large ones, and
    these their minima, three times each, and the driver plans all that again after every stage.
    """
    links = _star(_both(links), least.select("u", "n", "m"), True)
    least = cut(links.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m")), "least")
    return _star(links, least, False)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every linked node that is not the least of its component.

    Links may repeat, point either way or loop. Every step is written to the shared folder, and the
    rounds end when each node has one link, to a node that has none; no link comes to the driver, only
    a few counts per round. Links that are so from the start take no round.
    """
    links = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u <> v")
        .distinct()
    )
    links = cut(links, "links")
    while True:
        least = _both(links).groupBy("u").agg(
            F.count("*").alias("n"), F.least("u", F.min("v")).alias("m"), F.sum("up").alias("up"), F.max(1 - F.col("up")).alias("down")
        )
        least = cut(least, "least")
        count, most, between = least.agg(F.sum("up"), F.max("up"), F.max(F.col("up") * F.col("down"))).first()
        if not count or (most == 1 and not between):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        links = _stars(links, least)

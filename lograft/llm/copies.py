"""Near copies by SimHash fingerprints, with an exact check.

Texts are alike if their sets of word shingles share at least ``share`` of their union. Candidates are
texts whose fingerprints (``simhash``) differ in few bits; those whose fingerprints lie further apart
come from min-hashes in bands. Whatever these tie together is then compared exactly, set by set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.llm import simhash
from lograft.llm.common import cut, in_batches, join_hot, screened
from lograft.llm.components import components
from lograft.llm.simhash import _shingle_hashes

#: A pair with likeness s has a band in common with chance 1 - (1 - s^ROWS)^BANDS: 0.999997 for s = 0.8.
BANDS, ROWS = 32, 5
_RNG = np.random.default_rng(11)
_TIMES = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1)).astype(np.uint64)


def _set(text: str | None, n: int) -> np.ndarray:
    return np.unique(_shingle_hashes(text, n))


def _bands(own: np.ndarray) -> list[int]:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(own), 1024):
        np.minimum(low, (own[i : i + 1024] * _TIMES + _PLUS).min(axis=1), out=low)
    rows = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)]


def sketch(text: Column | str, shingle: int) -> Column:
    """``node``, a hash of the shingle set, ``bands``, those of its min-hashes (none for an empty set), and the fingerprint ``fp``."""

    @F.pandas_udf("struct<node:long,bands:array<long>,fp:long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [_set(t, shingle) for t in texts]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            bands = [np.array(_bands(s) if len(s) else [], np.uint64).view(np.int64) for s in sets]
            yield pd.DataFrame({"node": node, "bands": bands, "fp": simhash.prints(texts)})

    return run(text)


def alike(sets: list[np.ndarray], share: float) -> np.ndarray:
    """For each set the number of the first one in its group: all pairs count, whatever lies between them.

    A search from set to set that looks among those not yet reached only, so a large group of near
    copies takes few comparisons.
    """
    size, label = np.array([len(s) for s in sets]), np.full(len(sets), -1)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.empty(0, int)
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(sets)), size)

    def index() -> tuple[np.ndarray, np.ndarray, int]:
        """The sets not yet reached that hold each token."""
        left = label[owner] < 0
        order = np.argsort(token[left], kind="stable")
        held = np.bincount(token[left], minlength=token.max(initial=-1) + 1)
        return owner[left][order], np.concatenate([[0], np.cumsum(held)]), int((label < 0).sum())

    holders, at, built = index()
    left = built
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], queue, left = first, [first], left - 1
        while queue and left:
            if 2 * left <= built:
                holders, at, built = index()
            x = queue.pop()
            own = token[ends[x] - size[x] : ends[x]]
            start, n = at[own], at[own + 1] - at[own]
            flat = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            near, both = np.unique(holders[flat], return_counts=True)
            near = near[(label[near] < 0) & (both / np.maximum(1, size[x] + size[near] - both) >= share)]
            label[near] = first
            left -= len(near)
            queue += near.tolist()
    return label


def _compared(groups: DataFrame, keys: list[str], shingle: int, share: float) -> DataFrame:
    """``root, a, b, size, parts, text``: each node ``a`` with the first node ``b`` of its likes in the same group.

    A first node of a group in several parts keeps its text, since it meets those of the other parts next.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", ignore_index=True)  # the first of its likes is the least: links are stars already
        node, label = pdf["node"].to_numpy(), alike([_set(t, shingle) for t in pdf["text"]], share)
        goes_on = (label == np.arange(len(node))) & (pdf["parts"].to_numpy() > 1)
        return pd.DataFrame(
            {"root": pdf["root"], "a": node, "b": node[label], "size": pdf["size"], "parts": pdf["parts"], "text": pdf["text"].where(goes_on, None)}
        )

    rows = groups.select(*keys, "node", "size", "parts", "text")
    return rows.groupBy(*keys).applyInPandas(compare, "root long, a long, b long, size int, parts int, text string")


def _linkable(full: DataFrame, shingle: int, share: float, part: int) -> DataFrame:
    """``full`` without the nodes of roots in several parts that can have no link, and with parts dealt anew.

    A likeness of ``share`` takes that share of the own shingles at least. So a node goes if more of its
    shingles than the others' share leaves stand in no other node of its root: counts tell, no pairs.
    """
    many = full.filter("parts > 1")
    if many.isEmpty():
        return full

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_set(t, shingle).view(np.int64) for t in texts], dtype=object)

    sets = cut(many.select("root", "node", hashes("text").alias("set")), "sets")
    held = sets.select("root", "node", F.explode("set").alias("token")).groupBy("root", "token").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    own = held.filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    lone = sets.select("node", F.size("set").alias("all")).join(own.hint("merge"), "node").filter((F.col("all") - F.col("own")) / F.col("all") < share)
    rest = cut(many.drop("parts").join(lone.select("node").hint("merge"), "node", "left_anti"), "linkable")
    parts = rest.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / part).cast("int").alias("parts"))
    return full.filter("parts = 1").unionByName(cut(join_hot(rest, cut(parts, "parts"), "root"), "compare"))


def _links(full: DataFrame, shingle: int, share: float, part: int) -> DataFrame:
    """Links ``a, b`` inside the parts of each root, then among the first nodes of what the parts found alike.

    A group of near copies leaves few first nodes a part, so that each level is a fraction of the one
    before and all of them cost little more than reading the group once. A root whose first nodes
    fill more than half as many parts again stops there, and ``_apart`` does the rest.
    """
    links, level = [], full.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    while True:
        seen = cut(_compared(level, ["root", "part"], shingle, share), "compared")
        links.append(seen.filter("a <> b").select("a", "b"))
        firsts = seen.filter("a = b and parts > 1").select("root", F.col("a").alias("node"), "size", "text", F.col("parts").alias("before"))
        sums = firsts.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / part).cast("int").alias("parts"), F.first("before").alias("before"))
        fewer = cut(sums.filter("parts * 2 <= before").drop("before"), "parts")
        if fewer.isEmpty():
            break
        level = join_hot(firsts.drop("before"), fewer, "root")
        level = level.withColumn("part", F.pmod(F.xxhash64("node", F.lit(len(links))), "parts"))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _apart(full: DataFrame, found: DataFrame, shingle: int, share: float, tile: int) -> DataFrame | None:
    """Links between what ``found`` (node, own) leaves apart in the roots of several parts; None where it leaves nothing.

    Nodes outside the largest component of their root are compared with all others of the root, in
    tiles. Nodes inside it are one already and are not compared with each other again.
    """
    many = full.filter("parts > 1")
    own = F.coalesce("own", "node").alias("own")
    held = many.select("root", "node", "size").join(found.hint("merge"), "node", "left").groupBy("root", own).agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    top = F.max(F.struct("size", "own"))
    roots = held.groupBy("root").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum("size").alias("all"), top.alias("top")).filter("kinds > 1")
    tiles = lambda size: F.ceil(size / tile).cast("int")
    roots = cut(roots.select("root", "n", "top.own", tiles(F.col("all") - F.col("top.size")).alias("few"), tiles(F.col("top.size")).alias("rest")).withColumnRenamed("own", "top"), "apart")
    if roots.isEmpty():
        return None
    rows = join_hot(many.select("root", "node", "size", "text"), roots, "root").join(found.hint("merge"), "node", "left")
    small, at = own != F.col("top"), lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    each = lambda n, pair: F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda j: F.struct(*(c.alias(x) for c, x in zip(pair(j), ("lo", "hi")))))
    rows = rows.withColumn("at", F.when(small, at("few")).otherwise(F.col("few") + at("rest")))
    # Each tile meets itself in the first of the others.
    inside = F.filter(each("few", lambda j: (F.least("at", j), F.greatest("at", j))), lambda p: p["lo"] < p["hi"])
    across = each("rest", lambda j: (F.col("at"), F.col("few") + j))
    rows = rows.withColumn("p", F.explode(F.when(small, F.concat(inside, across)).otherwise(inside)))
    rows = rows.select("root", "p.lo", "p.hi", "node", "size", F.lit(1).alias("parts"), "text")
    return _compared(rows, ["root", "lo", "hi"], shingle, share).filter("a <> b").select("a", "b")


def _near_prints(nodes: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` that join all nodes whose fingerprints differ in at most ``radius`` bits.

    A fingerprint that ties nodes takes part under a hash of its own, so nodes meet it, not each other.
    """
    mark = lambda fp: F.xxhash64(F.col(fp), F.lit(5))
    prints = cut(nodes.groupBy("fp").agg(F.count("*").alias("n")), "prints")
    near = cut(simhash.links(prints.select("fp"), "fp", radius).distinct(), "near")
    tied = near.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(prints.filter("n > 1").select("fp")).distinct()
    met = join_hot(nodes.select("node", "fp"), cut(prints.join(tied.hint("merge"), "fp"), "tied"), "fp")
    return met.select(F.col("node").alias("a"), mark("fp").alias("b")).unionByName(near.select(mark("a").alias("a"), mark("b").alias("b")))


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, share: float = 0.8, tile: int = 1 << 23, part: int = 1 << 20, radius: int = 3
) -> DataFrame:
    """``id_col, component_id`` for every row of ``docs``.

    Rows whose shingle sets have a likeness (Jaccard) of at least ``share`` are linked, and
    ``component_id`` is the least id reachable; it is null only where all ids of the component are null.
    A text of fewer words than a shingle is one shingle; texts without words (or null) are alike. Rows
    that repeat keep one row each, other columns are ignored, an empty table gives an empty one.

    Equal sets meet once, as one node. Nodes whose fingerprints differ in at most ``radius`` bits or that
    share a band, directly or by others, have one root and are compared exactly. From roots of several parts the nodes go first that have too many shingles of
    their own for any link. The others meet in parts of about ``part`` characters, then the first nodes of
    the parts, and what is apart then in tiles of about ``tile`` characters, each with each. The result
    is the same for all sizes.
    """
    keyed = in_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = keyed.select("id", "text", F.xxhash64("id").alias("d"), F.xxhash64("text").alias("g"))
    marked = hashed.select("id", "d", "g", F.length("text").alias("n"), sketch("text", shingle).alias("s"))
    marked = cut(marked.select("id", "d", "g", "n", "s.node", "s.bands", "s.fp"), "sketches")
    one = F.min(F.struct("d", "g", "n", "bands"))
    nodes = cut(marked.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"), one.alias("one")), "nodes")
    bands = nodes.select("node", F.explode("one.bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("low")).filter("n > 1")
    tied = join_hot(bands, cut(shared, "bands"), "band").filter("node <> low").select("node", "low")
    near = _near_prints(cut(marked.select("node", "fp").distinct(), "fingerprints"), radius)
    roots = components(tied.unionByName(near.toDF("node", "low")), "node", "low")
    inner = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    size = F.col("one.n").alias("size")
    inner = cut(nodes.select("node", "one.d", "one.g", size).join(inner.hint("merge"), "node"), "candidates")
    part = min(part, tile)
    parts = inner.groupBy("root").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / part).cast("int").alias("parts"))
    inner = join_hot(inner, cut(parts, "parts"), "root")
    # Only rows that may be candidates are shuffled with their texts.
    both = F.xxhash64("d", "g")
    maybe = screened(hashed.drop("id"), inner.select(both.alias("k")), both).filter("maybe").drop("maybe")
    full = maybe.join(inner.hint("merge"), ["d", "g"]).dropDuplicates(["d", "g"]).select("root", "node", "size", "parts", "text")
    full = _linkable(cut(full, "compare"), shingle, share, part)
    found = components(_links(full, shingle, share, part), "a", "b").select("node", F.col("root").alias("own"))
    more = _apart(full, found, shingle, share, tile)
    if more is not None:
        found = components(found.unionByName(more.toDF("node", "own")), "node", "own").select("node", F.col("root").alias("own"))
    named = nodes.select("node", "least").join(found.hint("merge"), "node", "left")
    named = cut(named.select("node", "least", F.coalesce("own", "node").alias("root")), "roots")
    least = named.groupBy("root").agg(F.count("*").alias("n"), F.min("least").alias("component_id"))
    named = join_hot(named, cut(least, "least"), "root").select("node", "component_id")
    sizes = nodes.select("node", "n")
    named = cut(named.join(sizes.hint("merge"), "node"), "named")
    return join_hot(marked.select("id", "node"), named, "node").select(F.col("id").alias(id_col), "component_id")

"""SimHash near-duplicate groups by tiled, exact comparison of fingerprints.

Fingerprints come from Arrow batches with numpy; the comparison deals distinct fingerprints into
tiles by the population counts of their four 16-bit quarters. Two fingerprints that differ in at
most ``radius`` bits have quarter counts that differ by at most ``radius`` in sum, so tile pairs
beyond that are skipped without loss, and the others are compared whole: exclusive or, bit counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import cut, in_batches, join_hot
from lograft.llm.components import components

#: Seed of the shingle hash.
SEED = 42
#: The set bits of every byte value.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Shingles hashed before their bits are counted together.
_CHUNK = 1 << 18


def _shingle_hashes(text: str | None, n: int) -> np.ndarray:
    w = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII blanks divide
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    joined = map(b" ".join, zip(*(w[i:] for i in range(n))))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(w) - n + 1)


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    """One fingerprint per array: the bits that over half of its hashes have."""
    n = np.array([len(h) for h in hashes])
    flat, row = np.concatenate(hashes), np.repeat(np.arange(len(n)) * 256, n)
    out = np.zeros(len(n), np.uint64)
    for k in range(8):
        byte = ((flat >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)
        ones = np.bincount(row + byte, minlength=256 * len(n)).reshape(-1, 256) @ _BITS.astype(np.int64)
        for bit in range(8):
            out |= (2 * ones[:, bit] > n).astype(np.uint64) << np.uint64(8 * k + bit)
    return out


def prints(texts: pd.Series, shingle: int = 3) -> np.ndarray:
    """The fingerprints of whole texts as longs."""
    done, held, size = [], [], 0
    for t in texts:
        held.append(_shingle_hashes(t, shingle))
        size += len(held[-1])
        if size >= _CHUNK or len(held) >= 256:
            done.append(_majority(held))
            held, size = [], 0
    if held:
        done.append(_majority(held))
    return np.concatenate(done or [np.empty(0, np.uint64)]).view(np.int64)


def fingerprint(text: Column | str, shingle: int = 3) -> Column:
    """The 64-bit fingerprint of each whole text as a long; a text without words (or null) gets 0."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(prints(texts, shingle))

    return run(text)


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare all of ``a`` with all of ``b``; the links found, as ties of nodes to the least of each local group."""
    found_a, found_b = [], []
    step = max(1, (1 << 18) // max(1, len(b)))
    for i in range(0, len(a), step):
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        found_a.append(a[i + x])
        found_b.append(b[y])
    u, v = np.concatenate(found_a), np.concatenate(found_b)
    keep = u != v
    u, v = u[keep], v[keep]
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    at, label = at.reshape(2, -1), np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, at[0], label[at[1]])
        np.minimum.at(low, at[1], label[at[0]])
        low = low[low]
        if (low == label).all():
            break
        label = low
    tied = label != np.arange(len(nodes))
    return nodes[tied], nodes[label[tied]]


def links(prints: DataFrame, col: str, radius: int = 3, tile: int = 4096, fan: int = 64) -> DataFrame:
    """Links ``a, b`` (longs) that join all fingerprints within ``radius`` bits of each other.

    ``prints`` holds distinct fingerprints. Each tile pair gives the ties of its own groups instead
    of all pairs within them: the components are those of all links, and rows stay below the number
    of fingerprints in the two tiles. A tile holds about ``tile`` fingerprints; a cell with more is
    dealt into several by hash.

    Each tile goes to every tile of its neighbour cells. Tiles that about ``fan`` or more others go to
    stand in several places, and the others are dealt among these, so one key holds about ``fan`` pairs
    however crowded its cell is. The number of tasks follows the number of pairs, not of bytes.
    """
    quarters = [F.bit_count(F.shiftrightunsigned(col, 16 * k).bitwiseAND(0xFFFF)) for k in range(4)]
    cell = sum((q * 17**k for k, q in enumerate(quarters)), F.lit(0)).cast("int")
    keyed = prints.select(F.col(col).alias("fp"), cell.alias("cell"))
    # At most 17^4 cells whatever the input, so tables with a row for each may be broadcast.
    parts = cut(keyed.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")), "cells")
    tiles = (
        keyed.join(F.broadcast(parts), "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), "parts").cast("int").alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = cut(tiles, "tiles")
    steps = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    half = [d for d in steps if d >= (0, 0, 0, 0)]
    offsets = F.array(*(F.struct(*(F.lit(x).alias(f"d{k}") for k, x in enumerate(d))) for d in half))

    def neighbours(rows: DataFrame) -> DataFrame:
        """A row for each neighbour cell there is: ``from`` is the cell itself, ``cell`` the neighbour, ``parts`` its tiles."""
        digits = [(F.floor(F.col("cell") / 17**k) % 17).alias(f"q{k}") for k in range(4)]
        near = rows.select(F.col("cell").alias("from"), *(c for c in rows.columns if c != "cell"), *digits).withColumn("d", F.explode(offsets))
        for k in range(4):
            near = near.withColumn(f"q{k}", F.col(f"q{k}") + F.col(f"d.d{k}")).filter(f"q{k} between 0 and 16")
        to = sum((F.col(f"q{k}") * 17**k for k in range(4)), F.lit(0)).cast("int")
        return near.withColumn("cell", to).drop("d", *(f"q{k}" for k in range(4)))

    come = neighbours(parts).groupBy("cell").agg(F.sum("parts").alias("come"))
    spread = cut(parts.join(come, "cell").withColumn("salts", F.ceil(F.col("come") / fan).cast("int")), "spread")
    pairs = spread.agg(F.sum(F.col("parts") * F.col("come"))).first()[0] or 0
    tasks = int(min(100_000, max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // 4096)))
    salt = F.pmod(F.xxhash64("from", "from_part"), "salts").cast("int").alias("salt")
    left = neighbours(tiles.select("cell", F.col("part").alias("from_part"), F.col("fps").alias("x"))).join(F.broadcast(spread), "cell")
    left = left.select("from", "from_part", "x", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), salt)
    right = tiles.join(F.broadcast(spread), "cell").select("cell", "part", "fps", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    key = ["cell", "part", "salt"]
    pairs = left.repartition(tasks, *key).join(right.repartition(tasks, *key).hint("merge"), key).filter("from <> cell or from_part <= part")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [
                _forest(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), radius)
                for x, y in zip(batch["x"], batch["y"])
            ]
            a, b = (np.concatenate([g[k] for g in got] or [np.empty(0, np.uint64)]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return pairs.select("x", F.col("fps").alias("y")).mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``.

    Whole texts; null or empty texts have fingerprint 0 and are linked like any other. Rows that
    repeat keep one row each. ``component_id`` is the least id reachable; it is null only where all
    ids of the component are null. Further columns of ``docs`` are ignored, an empty table gives an
    empty one. Equal fingerprints meet once, as one node, however many rows share them.
    """
    marked = cut(in_batches(docs).select(F.col(id_col), fingerprint(text_col, shingle).alias("fp")), "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, "fp", radius), "a", "b")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(least, "root").select("fp", "n", "component_id"), "named")
    return join_hot(marked, named, "fp").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

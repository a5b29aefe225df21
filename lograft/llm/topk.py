"""Exact top-k search by inner product with block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import cut, in_batches
from lograft.sources.scratch import new_path


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """``id, v``: components turned into ``floor(scale * x)``; vectors that are null or hold null or non-finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(x.isNotNull() & sound).select(
        F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v")
    )


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Integer inner products, by floating point where that is exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ m.T.astype(np.float64)).astype(np.int64)
    return q @ m.T


class Blocks:
    """Candidates of one segment as blocks of a range of ids, each with the largest and least of every component."""

    def __init__(self, nth: np.ndarray, ids: np.ndarray, m: np.ndarray, rows: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.nth, self.ids, self.m = nth[order], ids[order], m[order]
        self.at = np.arange(0, len(ids), rows)
        self.high = np.maximum.reduceat(self.m, self.at, axis=0)
        self.low = np.minimum.reduceat(self.m, self.at, axis=0)
        self.rows = rows

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and block the sum of the most that each component can give."""
        return _products(np.maximum(q, 0), self.high) + _products(np.minimum(q, 0), self.low)

    def best(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """Up to ``k`` (score, row) per query, best first, leaving out scores below its ``floor`` and its own row.

        Each query takes blocks from the greatest bound down and stops at the first whose bound is
        below its kth score; queries that want the same block next are scored together. A score equal
        to the kth may win by its smaller id, so such rows and blocks are kept.
        """
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        held: list[list[tuple[int, int, int]]] = [[] for _ in q]
        kth, step, self.scored = floor.copy(), 0, 0
        live = np.nonzero(bound[np.arange(len(q)), order[:, 0]] >= kth)[0]
        while len(live) and step < len(self.at):
            want = order[live, step]
            self.scored += len(live)
            for b in np.unique(want):
                who = live[want == b]
                lo, hi = self.at[b], min(self.at[b] + self.rows, len(self.nth))
                scores, rows = _products(q[who], self.m[lo:hi]), np.arange(lo, hi)
                for i, s in zip(who, scores):
                    pick = np.nonzero(s >= kth[i])[0]
                    pick = pick[self.nth[rows[pick]] != own[i]]
                    if len(pick) > k:  # ids rise, and the sort keeps their order among ties
                        pick = pick[np.argsort(-s[pick], kind="stable")[:k]]
                    if len(pick):
                        new = held[i] + [(int(s[j]), int(self.ids[rows[j]]), int(rows[j])) for j in pick]
                        held[i] = sorted(new, key=lambda x: (-x[0], x[1]))[:k]
                        if len(held[i]) >= k:
                            kth[i] = max(kth[i], held[i][k - 1][0])
            step += 1
            if step < len(self.at):
                live = live[bound[live, order[live, step]] >= kth[live]]
        return [[(s, n) for s, _, n in h] for h in held]


_LEAST = np.iinfo(np.int64).min


def search(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50,
    scale: float = 256.0, segment: int = 16384, queries: int = 4096, block: int = 512, wave: int = 32 << 20,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of every query, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's own.
    Rows that repeat an id are queries and candidates each for itself. Vectors with null or non-finite
    components take no part, nor do rows with a null id; vectors of another length than the query's
    are no candidates. Components so large that a score may leave 64 bits are an error. Other columns
    are ignored, an empty table gives an empty one.

    Candidates lie in segments of about ``segment`` rows, ranges of the id. Every query first meets the
    segment it lies in. Its kth score there is the floor for all others, which it meets in groups of
    about ``queries``: blocks bounded below the floor are not scored, and what is below it never leaves
    a task. Segments are never shuffled to meet queries: these are broadcast in waves of at most ``wave`` bytes of
    components (a group at least), and each segment answers a wave where it is read.
    """
    found = whole_numbers(vectors.filter(F.col(id_col).isNotNull()), id_col, vector_col, scale).withColumn("dims", F.size("v")).filter("dims > 0")
    size = found.agg(F.count("*"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.max("dims")).first()
    if size[0] and float(size[1]) ** 2 * size[2] >= 2**63:
        raise ValueError(f"a component of {size[1]} makes scores of more than 64 bits")
    parts = -(-size[0] // segment) or 1
    found = cut(found.repartitionByRange(parts, "dims", "id").withColumn("part", F.spark_partition_id()), "vectors")
    found = cut(found.withColumn("nth", F.monotonically_increasing_id()), "numbered")
    row = F.struct("nth", "id", "v")
    segments = cut(found.groupBy("dims", "part").agg(F.collect_list(row).alias("rows")), "segments")
    asked = found.filter(F.col("id") % every == 0)

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for dims, part, asked, rows in zip(batch["dims"].to_pylist(), batch["part"].to_pylist(), batch["asked"], batch["rows"]):
                sides = []
                for side in (asked, rows):
                    s = side.values
                    v = s.field("v").flatten().to_numpy(zero_copy_only=False)
                    sides.append((s, s.field("nth").to_numpy(), s.field("id").to_numpy(), v.reshape(len(s), dims)))
                (a, own, ids, q), (_, nth, names, m) = sides
                floor = np.full(len(q), _LEAST)
                if "floor" in [f.name for f in a.type]:
                    floor = a.field("floor").to_numpy()
                    new = np.nonzero(a.field("home").to_numpy() != part)[0]  # each has been in its home
                    own, ids, q, floor = own[new], ids[new], q[new], floor[new]
                blocks = Blocks(nth, names, m, block)
                best = blocks.best(q, own, floor, k)
                out = [(o, i, int(blocks.ids[n]), s) for o, i, b in zip(own.tolist(), ids.tolist(), best) for s, n in b]
                cols = list(zip(*out)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["nth", "query_id", "vec_id", "score"])

    scored = "nth long, query_id long, vec_id long, score long"
    home = asked.groupBy("dims", "part").agg(F.collect_list(row).alias("asked")).join(segments, ["dims", "part"])
    home = cut(home.select("dims", "part", "asked", "rows").mapInArrow(score, scored), "home")
    floors = home.groupBy("nth").agg(F.count("*").alias("n"), F.min("score").alias("low")).filter(F.col("n") >= k)
    count = asked.count()
    groups = -(-count // queries) or 1
    away = asked.join(floors, "nth", "left").withColumn("floor", F.coalesce("low", F.lit(int(_LEAST))))
    away = away.select("dims", "nth", "id", "v", "floor", F.col("part").alias("home"), F.pmod(F.xxhash64("nth"), F.lit(groups)).alias("group"))
    away = cut(away, "asked")
    # about so many groups have ``wave`` bytes; a table of one group more or less changes nothing but the size
    at_once = max(1, min(groups, wave // max(1, 8 * (size[2] or 1) * queries)))
    path = new_path(vectors.sparkSession, "near")
    for first in range(0, groups, at_once):
        some = away.filter((F.col("group") >= first) & (F.col("group") < first + at_once))
        some = some.groupBy("dims", "group").agg(F.collect_list(F.struct("nth", "id", "v", "floor", "home")).alias("asked"))
        units = segments.join(F.broadcast(some), "dims").select("dims", "part", "asked", "rows")
        in_batches(units, 16 << 20).mapInArrow(score, scored).write.parquet(f"{path}/wave={first}")
    near = vectors.sparkSession.read.schema(scored).parquet(f"{path}/wave=*").unionByName(home)
    rank = F.expr("row_number() over (partition by nth order by score desc, vec_id)")
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

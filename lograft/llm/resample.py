"""Resampling documents towards a target distribution: weights by feature buckets, the highest scores by an exact parallel sort.

Scores are sorted by regular sampling: every run (a file of the sorted table) gives keys at a regular
distance, these give splitters, each row goes to the segment between two splitters, segments are merged
where they arrive, and counts of the segments before give each row its exact rank.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate
from math import ceil, floor, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograft.llm.common import cut
from lograft.operators.cleaning import computed_once

#: Characters between words once capitals are small.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The least id: null ids are sorted as if they were it.
_LEAST = -(1 << 63)
#: What rows are sorted by, in this order.
KEY = ("falling", "id", "n_features", "weight", "at")


def _words(text: Column) -> Column:
    """Words of a text with A to Z in small letters; where all is ASCII, the faster ``lower`` says the same."""
    text = F.coalesce(text, F.lit(""))
    small = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _CAPITALS, _SMALL))
    return F.array_remove(F.split(small, _BETWEEN), "")


def _run_at(n: int, place: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda i: place(F.concat_ws(" ", *(F.get("w", i + k) for k in range(n))))


def featured(docs: DataFrame, buckets: int, longest: int) -> DataFrame:
    """``docs`` with ``n_words`` and ``b``, the bucket of each run of 1 to ``longest`` words, in place of the text."""
    kept = [c for c in docs.columns if c != "text"]
    listed = computed_once(docs, w=_words(F.col("text")))
    place = lambda x: F.pmod(F.crc32(x.cast("binary")), F.lit(buckets)).cast("int")
    runs = [F.transform("w", place)]
    for n in range(2, longest + 1):
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)).otherwise(F.array().cast("array<int>"))
        runs.append(F.transform(starts, _run_at(n, place)))
    return listed.select(*kept, F.size("w").cast("long").alias("n_words"), (F.concat(*runs) if runs[1:] else runs[0]).alias("b"))


def _counts(feats: DataFrame, buckets: int) -> np.ndarray:
    """Features by bucket: at most ``buckets`` numbers come to the driver."""
    out = np.zeros(buckets, np.int64)
    for r in feats.select(F.explode("b").alias("b")).groupBy("b").count().collect():
        out[r["b"]] = r["count"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Per bucket ``floor(1000 ln(((t + 1) (S + B)) / ((s + 1) (T + B))))`` with S and T all features, B the number of buckets."""
    n, S, T = len(corpus), int(corpus.sum()), int(target.sum())
    return [floor(1000 * log(float(t + 1) * float(S + n) / (float(s + 1) * float(T + n)))) for s, t in zip(corpus, target)]


def sorted_ranks(rows: DataFrame, segments: int, drawn: int, total: int, most_samples: int = 1 << 16) -> DataFrame:
    """Add ``rank``, 1 for the least ``KEY``, to the ``drawn`` least of ``total`` written rows in sorted runs; null to the others.

    ``at`` is the number of the run times 2^33, and the place in it. Each run gives the keys at every
    ``total / segments^2``-th place, at a wider distance where these were over ``most_samples``, which bounds what comes
    to the driver; the distance changes how equal segments are, not the result. Segments behind the last
    drawn row are not shuffled at all.
    """
    stride = max(1, ceil(total / min(segments * segments, most_samples)))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sample = sorted(tuple(r) for r in rows.filter(place % stride == stride // 2).select(*KEY).collect())
    splitters = sorted({sample[len(sample) * k // segments] for k in range(1, segments)}) if sample else []
    heads = [s[0] for s in splitters]
    equal = set(heads)

    @F.pandas_udf("int")
    def segment(falling: pd.Series, i: pd.Series, n: pd.Series, w: pd.Series, at: pd.Series) -> pd.Series:
        out = np.searchsorted(np.array(heads, np.int64), falling.to_numpy(), side="right")
        for k in np.flatnonzero(falling.isin(equal)):  # the score alone does not tell
            out[k] = bisect_right(splitters, (falling[k], i[k], n[k], w[k], at[k]))
        return pd.Series(out.astype(np.int32))

    dealt = cut(rows.withColumn("segment", segment(*KEY)), "segments")
    counts = dict(map(tuple, dealt.groupBy("segment").count().collect()))
    before = [0, *accumulate(counts.get(k, 0) for k in range(len(splitters) + 1))]
    first = next((k for k, n in enumerate(before) if n >= drawn), len(before))
    merged = Window.partitionBy("segment").orderBy(*KEY)
    offset = F.get(F.array(*map(F.lit, before)).cast("array<bigint>"), F.col("segment"))
    ranked = dealt.filter(F.col("segment") < first).withColumn("rank", offset + F.row_number().over(merged))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = dealt.filter(F.col("segment") >= first).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("segment")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, longest: int = 1, least_words: int = 20, seed: int = 2024, segments: int | None = None
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; the ``percent`` best of those with ``least_words`` words are ranked.

    A document's weight is the sum of its features' gains towards the texts of ``target``; its score adds Gumbel
    noise made from its id, so that ranking draws without replacement by weight. Null and empty texts have
    no features and weight 0. A null id is written as no characters for the noise and is smaller than
    all others. Ties go to the smaller id; rows that repeat with their id are ranked by features and
    weight, wholly equal ones in any order. Empty tables give what they hold; an empty target makes
    frequent features bad. Other columns of ``docs`` are not looked at. ``segments`` is the number of sorted
    segments, by default that of shuffle partitions.
    """
    spark = docs.sparkSession
    feats = cut(featured(docs.select("doc_id", "text"), buckets, longest), "features")
    gain = gains(_counts(feats, buckets), _counts(featured(target.select("text"), buckets, longest), buckets))
    table = F.lit(np.array(gain, np.int64))
    weight = F.aggregate("b", F.lit(0).cast("long"), lambda a, k: a + F.get(table, k))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = feats.select("doc_id", "n_words", F.size("b").cast("long").alias("n_features"), weight.alias("weight"), noise.alias("noise"))
    scored = scored.select("*", (F.col("weight") + F.col("noise")).alias("score")).select(
        "*", (-F.col("score")).alias("falling"), F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), (F.col("n_words") >= least_words).alias("long_enough")
    )
    runs = scored.sortWithinPartitions(F.desc("long_enough"), *KEY[:-1])
    runs = cut(runs.withColumn("at", F.monotonically_increasing_id()), "runs")
    able = runs.filter("long_enough")
    total = able.count()
    ranked = sorted_ranks(able, segments or int(spark.conf.get("spark.sql.shuffle.partitions")), total * percent // 100, total)
    rest = runs.filter("not long_enough").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")

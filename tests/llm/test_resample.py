"""Resampling against a plain version, and the sort by regular sampling for any number of segments."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from lograft.llm import resample
from tests.llm.helpers import docs, rows_of


def brute(rows, target, percent=10, buckets=10_000, longest=1, least_words=20, seed=2024):
    def feats(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        runs = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return len(w), [zlib.crc32(x.encode()) % buckets for x in runs]

    own = [(i, *feats(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in feats(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], -(2**63) if r[0] is None else r[0], r[2], r[3]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted((tuple(r[:1] + r[2:]) + (rank.get(id(r)),) for r in out), key=repr)


def rows_for(n=400):
    rng = random.Random(11)
    say = lambda k: " ".join(rng.choices(["Alpha", "beta", "gamma9", "Ünï", "日本", "del-ta", "x_y", "zeta's", "ÉTA"], k=k))
    rows = [(i, say(rng.choice([0, 5, 19, 20, 60]))) for i in range(n)]
    rows += [(None, rows[4][1]), (None, None), (1000, None), (1001, ""), (1002, "... !"), (1003, "wort " * 200_000)] + [(7, say(50))] * 40 + [(i, "same words " * 30) for i in range(2000, 2030)]
    return rows, ["Alpha beta alpha", "gamma9 日本 Ünï", None, ""]


@pytest.mark.parametrize("how", [{}, {"segments": 1}, {"segments": 7}, {"segments": 60}, {"percent": 100, "segments": 9}, {"longest": 3, "buckets": 97, "least_words": 1, "percent": 37}])
def test_resample(spark, how):
    rows, target = rows_for()
    bench = spark.createDataFrame([(str(k), t) for k, t in enumerate(target)], "item_id string, text string")
    got = rows_of(resample.resample(docs(spark, rows, extra=True).repartition(6), bench, **how))
    assert sorted(got, key=repr) == brute(rows, target, **{k: v for k, v in how.items() if k != "segments"})


def test_resample_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert resample.resample(docs(spark, []), bench).count() == 0
    got = rows_of(resample.resample(docs(spark, [(1, "a b"), (2, None)]), bench))
    assert {r[0]: (r[1], r[4]) for r in got} == {1: (2, None), 2: (0, None)}


def test_few_samples_change_no_rank(spark):
    rows, target = rows_for(900)
    bench = spark.createDataFrame([("x", target[0])], "item_id string, text string")
    runs = resample.resample(docs(spark, rows).repartition(5), bench, percent=100, least_words=0)
    from pyspark.sql import functions as F

    from lograft.llm.common import cut

    scored = runs.select("*", (-F.col("score")).alias("falling"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id")).drop("rank")
    written = cut(scored.repartition(4).sortWithinPartitions(*resample.KEY[:-1]).withColumn("at", F.monotonically_increasing_id()), "runs")
    n = written.count()
    for most in (1, 10, 1 << 16):
        got = resample.sorted_ranks(written, 8, n // 3, n, most_samples=most).collect()
        assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, n // 3 + 1)) and len(got) == n
        want = sorted(tuple(r[c] for c in resample.KEY) for r in got)[: n // 3]
        assert [tuple(r[c] for c in resample.KEY) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == want

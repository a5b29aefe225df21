"""Statistics against a plain version, estimates against concentration steps in numpy, and what is kept."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from lograft.llm import outliers
from lograft.llm.common import cut
from tests.llm.helpers import docs, rows_of

SF = "/root/testdata/sf0.01"


def plain(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    inside = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_statistics(spark):
    rng = random.Random(2)
    vocab = ["ab", "c#", "日本", "$", "x<y>", "\U00020000é", "w|", "*"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t ", "\r\n", " ", "\n\n"]) for _ in range(rng.choice([0, 3, 9, 30, 120])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "a b c d e a b c d e"), (204, "a a a a a a"), (205, "line\nline\n \n \nline"), (206, "wort " * 100_000), (206, "wort " * 100_000), (None, "x y z v w q")]
    got = rows_of(outliers.judge(docs(spark, rows, extra=True)))
    want = sorted(((i, *plain(t)) for i, t in rows), key=repr)
    assert sorted((r[:6] for r in got), key=repr) == want
    for r in got:
        assert r[6] == (r[1] < 10 or 100 * r[5] > 20 * r[1]) and not (r[6] and r[7])


def concentrated(x, fit, h_share):
    """The same estimate in numpy: both starts, nearest rows in whole bins."""
    best = None
    for start in (0, 1):
        q1, m, q3 = np.percentile(x, [25, 50, 75], axis=0, method="inverted_cdf")
        s = np.sqrt(((q3 - q1) / 1.349) ** 2 + np.square(fit.floor))
        cov = np.diag(s**2)
        if start:
            cov = (np.cov(np.tanh((x - m) / s).T, bias=True) + np.eye(x.shape[1]) * 0.01) * np.outer(s, s)
        for _ in range(fit.steps):
            d2 = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(cov), x - m)
            b = np.floor(np.log2(1 + d2) * fit.bins)
            edges, counts = np.unique(b, return_counts=True)
            last = edges[np.searchsorted(np.cumsum(counts), np.ceil(h_share * len(x)))]
            near = x[b <= last]
            m, cov = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(np.square(fit.floor))
        got = (np.linalg.det(cov), m, cov, 2 ** ((last + 1) / fit.bins) - 1)
        best = got if best is None or got[0] < best[0] else best
    return best[1], best[2] * max(1.0, best[3] / outliers._AT_COVERAGE)


def test_estimates_are_those_of_plain_steps(spark):
    rng = np.random.default_rng(6)
    fit = outliers.Fit(steps=6, tol=0.0)
    groups = {("en", "a"): 900, ("en", None): 60, (None, None): 9}
    rows, by = [], {}
    for (lang, source), n in groups.items():
        mix = rng.normal(size=(5, 5)) * 0.3 + np.eye(5)
        x = rng.normal(size=(n, 5)) @ mix + rng.normal(size=5)
        x[: n // 6] += 15
        by[lang, source] = x
        rows += [(lang, source, True, *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, "g_lang string, g_source string, g_leaf boolean, x0 double, x1 double, x2 double, x3 double, x4 double").repartition(5)
    got = {(r["g_lang"], r["g_source"]): r for r in outliers.estimate(cut(df, "rows"), fit).collect()}
    assert set(got) == set(groups)
    for key, x in by.items():
        centre, cov = concentrated(x, fit, fit.coverage)
        assert got[key]["all"] == len(x)
        assert np.allclose(got[key]["centre"], centre, atol=1e-6) and np.allclose(got[key]["cov"], cov, atol=1e-6)
        own = x[len(x) // 6 :]
        assert np.linalg.norm(centre - own.mean(axis=0)) < np.linalg.norm(x.mean(axis=0) - own.mean(axis=0)) or len(x) < 10


def test_odd_documents_go_and_clean_ones_stay(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(4000)]
    say = lambda n: "\n".join(" ".join(rng.choices(vocab, k=12)) for _ in range(max(1, n // 12)))
    clean = [(i, say(int(rng.lognormvariate(5.5, 0.8))), rng.choice(["en", "de", None]), None) for i in range(900)]
    odd = [(2000 + i, " ".join(rng.choice(vocab) + "#$%&*" * 3 for _ in range(150)), "en") for i in range(20)]
    odd += [(3000 + i, " ".join("".join(rng.choices("abcdefghij", k=60)) for _ in range(100)), "de") for i in range(20)]
    odd += [(4000 + i, "\n".join([f"{rng.choice(vocab)} {rng.choice(vocab)} x{i}"] * 40 + [say(600)]), "en") for i in range(10)]
    rows = [r[:3] for r in clean] + odd
    got = {r["doc_id"]: r for r in outliers.judge(docs(spark, rows)).collect()}
    kept_clean = sum(got[r[0]]["kept"] for r in clean if not got[r[0]]["base_failed"])
    able = sum(not got[r[0]]["base_failed"] for r in clean)
    assert kept_clean == able and able > 880
    assert not any(got[r[0]]["kept"] for r in odd)


def test_labelled_good_documents_stay(spark):
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = outliers.judge(df).join(labels, "doc_id").filter("quality = 1 and not base_failed")
    rows = seen.groupBy("kept").count().collect()
    counts = {r["kept"]: r["count"] for r in rows}
    assert counts[True] > 0.99 * sum(counts.values())


def test_nothing(spark):
    assert outliers.judge(docs(spark, [])).count() == 0
    got = rows_of(outliers.judge(docs(spark, [(1, None), (2, "a b c")])))
    assert sorted((r[0], r[6], r[7]) for r in got) == [(1, True, False), (2, True, False)]
    one = rows_of(outliers.judge(docs(spark, [(1, "a b c d e f g h i j k")])))
    assert one[0][7] is True

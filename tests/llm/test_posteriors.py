"""The chances of op1 from text to end against a plain version: features, folds, weights, calibration, scores."""

import math
import struct
from collections import Counter

import regex
import xxhash
from pyspark.sql import functions as F

from lograft.llm import mixing
from tests.llm.helpers import docs
from tests.llm.test_corpus import labelled


def chained(*values):
    """Spark's xxhash64 of texts (str), longs (int) and ints (as 1-tuples)."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def marks(text):
    text = text or ""
    n_tokens = len([w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w])
    plain = regex.split(r"[^\p{L}\p{N}]+", text.lower())
    n, letters = max(n_tokens, 1), max(len(text), 1)
    capitals = letters - sum(not "A" <= c <= "Z" for c in text)
    shares = {"new": len(set(plain)) * 10 / max(len(plain), 1), "length": len(text) / n, "upper": capitals * 10 / letters}
    # the empty mark may stand among the words and among the signs, and then counts for each
    return n_tokens, [*set(plain), *set(regex.split(r"[^!-/:-@\[-`{-~]+", text)), *(f"\x02{k}{math.floor(v)}" for k, v in shares.items())]


def weights(rows, left, label, fit):
    used = [r for r in rows if r["fold"] != left]
    n, count = len(used), sum(r[label] for r in used)
    seen, own = Counter(m for r in used for m in r["marks"]), Counter(m for r in used if r[label] for m in r["marks"])
    support = Counter(m for r in rows for m in r["marks"])
    found = []
    for m, k in seen.items():
        if support[m] < fit.support or k < fit.support:
            continue
        p, apart = k / max(n, 1), 1 / max(count, 1) + 1 / max(n - count, 1)
        z = abs(own[m] / max(count, 1) - (k - own[m]) / max(n - count, 1)) / math.sqrt(max(p * (1 - p) * apart, 1e-12))
        if z >= fit.z:
            found.append((-z, m, round(math.log((own[m] + 0.5) / (count + 1)) - math.log((k - own[m] + 0.5) / (n - count + 1)), 6)))
    return {m: w for _, m, w in sorted(found)[: fit.features]}


def score(own, table):
    x = sum(w for m, w in table.items() if m in own)
    return math.copysign(math.log1p(abs(x)), x) if x else 0.0


def plain(rows, known, fit):
    first = {}
    for i, text in rows:
        if i in known:
            toxic, good = known[i]
            old = first.get(text or "", (0, 1))
            first[text or ""] = (max(toxic, old[0]), min(good, old[1]))
    learned = [{"toxic": t, "good": g, "marks": marks(x)[1], "fold": chained(chained(x), (mixing._SEED,)) % fit.folds} for x, (t, g) in first.items()]
    chance = {}
    for label in mixing.LABELS:
        by_fold = {f: weights(learned, f, label, fit) for f in range(fit.folds)}
        a, b = mixing._calibrate([(round(score(r["marks"], by_fold[r["fold"]]), 6), r[label]) for r in learned])
        table = weights(learned, None, label, fit)
        chance[label] = lambda own, a=a, b=b, table=table: 1 / (1 + math.exp(-(a * score(own, table) + b)))
    out = []
    for i, text in rows:
        n, own = marks(text)
        t, g = chance["toxic"](own), chance["good"](own)
        out.append((i, n, (1 - t) * g, (1 - t) * (1 - g), t))
    return out


def test_chances_are_those_of_the_plain_version(spark):
    rows, told = labelled(spark, 700)
    rows = rows + [(900, None), (901, ""), (902, "VILE vile!! " * 9), (903, "ÉTÉ été 12,5 %%% " * 3), (902, "VILE vile!! " * 9), (3, rows[3][1]), (905, "wort " * 60_000)]
    told = told + [(903, 0, 1), (901, 1, 0), (3, 0, 1), (None, 1, 1), (4444, 1, 1)]
    known = {}
    for i, quality, toxic in told:
        if i is not None:
            t, g = known.get(i, (0, 1))
            known[i] = (max(t, toxic), min(g, quality))
    fit = mixing.Fit(z=3.0)
    got = mixing.posteriors(docs(spark, rows, extra=True), spark.createDataFrame(told, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x")), fit).collect()
    want = plain(rows, known, fit)
    assert len(got) == len(want)
    for r, w in zip(sorted(got, key=lambda r: (r["doc_id"], r["n_tokens"])), sorted(want, key=lambda r: (r[0], r[1]))):
        assert (r["doc_id"], r["n_tokens"]) == w[:2] and all(abs(r[d] - x) < 2e-3 for d, x in zip(mixing.DOMAINS, w[2:])), (r, w)
    assert {max(mixing.DOMAINS, key=lambda d: r[d]) for r in got} == set(mixing.DOMAINS)

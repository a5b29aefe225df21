"""Mixing to target weights with soft domain membership, all in DataFrame operations.

A classifier learned from the labelled table gives every document a posterior over domains, and a
projected-gradient least-squares fit gives it a nonnegative rate, such that the expected tokens of
each domain match the targets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import cut, words
from lograft.operators.cleaning import computed_once

DOMAINS = ("high", "low", "toxic")
_SEED = 11


@dataclass(frozen=True)
class Fit:
    """Bounds of the classifier: labelled rows it learns from, features it keeps per label, the labelled
    rows and z-score that a feature needs, and the folds of the calibration."""

    labelled: int = 20_000
    features: int = 200
    support: int = 8
    z: float = 5.0
    folds: int = 3


LABELS = ("toxic", "good")
#: Weights by fold (None: learned from all folds) and label: the feature and its weight.
Weights = dict[tuple[int | None, str], dict[str, float]]


def _marked(docs: DataFrame) -> DataFrame:
    """Add ``n_tokens``, the words of a whole text, and ``marks``, its distinct features: words without signs
    in lower case, runs of ASCII signs, and steps of three shares (unlike words, letters per word, capitals)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = computed_once(docs, n_tokens=F.size(words(text)).cast("long"), plain=F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    docs = computed_once(docs, low=F.array_distinct("plain"))
    n, letters = F.greatest(F.col("n_tokens"), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    signs = F.array_distinct(F.split(text, r"[^!-/:-@\[-`{-~]+"))
    capitals = letters - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    shares = (("new", F.size("low") * 10 / F.greatest(F.size("plain"), F.lit(1))), ("length", F.length(text) / n), ("upper", capitals * 10 / letters))
    steps = F.array(*(F.concat(F.lit(f"\x02{k}"), F.floor(v).cast("string")) for k, v in shares))
    return docs.withColumn("marks", F.concat("low", signs, steps)).drop("plain", "low")


def _weights(known: DataFrame, bounds: Fit) -> Weights:
    """The features that tell a label, with their log ratios of document frequencies, from rows of ``fold, toxic, good, marks``.

    At most ``2 * (folds + 1) * bounds.features`` weights come to the driver, whatever the input.
    """
    per_fold = [(f, name, F.col(name)) for f in range(bounds.folds) for name in ("n", *LABELS)]
    each = known.select("fold", *LABELS, F.lit(1).alias("n"), F.explode("marks").alias("mark"))
    each = each.groupBy("mark").agg(*(F.sum(F.when(F.col("fold") == f, c).otherwise(0)).alias(f"{name}{f}") for f, name, c in per_fold))
    all_n = sum((F.col(f"n{f}") for f in range(bounds.folds)), F.lit(0))
    each = cut(each.filter(all_n >= bounds.support), "marks")
    sums = known.agg(*(F.sum(F.when(F.col("fold") == f, F.lit(1) if name == "n" else c).otherwise(0)) for f, name, c in per_fold)).first()
    total = {(f, name): sums[k] or 0 for k, (f, name, _) in enumerate(per_fold)}
    out: Weights = {}
    for left in (None, *range(bounds.folds)):
        used = [f for f in range(bounds.folds) if f != left]
        n, seen = sum(total[f, "n"] for f in used), sum((F.col(f"n{f}") for f in used), F.lit(0))
        for label in LABELS:
            count, own = sum(total[f, label] for f in used), sum((F.col(f"{label}{f}") for f in used), F.lit(0))
            inside, outside = own + 0.5, seen - own + 0.5
            ratio = F.log(inside / (count + 1.0)) - F.log(outside / (n - count + 1.0))
            # The z-score of the two shares, as for equal shares.
            p, apart = seen / max(n, 1), 1 / max(count, 1) + 1 / max(n - count, 1)
            z = F.abs(own / max(count, 1) - (seen - own) / max(n - count, 1)) / F.sqrt(F.greatest(p * (1 - p) * apart, F.lit(1e-12)))
            top = each.filter((seen >= bounds.support) & (z >= bounds.z)).orderBy(z.desc(), "mark").limit(bounds.features)
            out[left, label] = {r[0]: r[1] for r in top.select("mark", F.round(ratio, 6)).collect()}
    return out


def _score(marks: Column, weights: dict[str, float]) -> Column:
    """The sum of the weights of ``marks``, in place: those that have one are picked first, by hash."""
    if not weights:
        return F.lit(0.0)
    names = F.array(*(F.lit(m) for m in weights))
    table = F.create_map(*(F.lit(x) for m, w in weights.items() for x in (m, float(w))))
    return _squash(F.aggregate(F.array_intersect(marks, names), F.lit(0.0), lambda a, m: a + F.coalesce(table[m], F.lit(0.0))))


def _squash(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _calibrate(scored: list[tuple[float, int]], steps: int = 60) -> tuple[float, float]:
    """Slope and intercept that make ``sigmoid(a * s + b)`` the chance of a label.

    Newton steps towards targets that n rows allow: (n1 + 1) / (n1 + 2) and 1 / (n0 + 2), so that
    scores which part the labels give chances near to 0 and 1, but no nearer than that many rows show.
    """
    if not scored:
        return 1.0, 0.0
    ones = sum(y for _, y in scored)
    high, low = (ones + 1) / (ones + 2), 1 / (len(scored) - ones + 2)
    rate = ones * high + (len(scored) - ones) * low
    a, b = 0.0, math.log(rate / (len(scored) - rate))
    for _ in range(steps):
        ga = gb = haa = hab = hbb = 1e-9
        for s, y in scored:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * s + b))))
            r, v = p - (high if y else low), p * (1 - p)
            ga, gb, haa, hab, hbb = ga + r * s, gb + r, haa + v * s * s, hab + v * s, hbb + v
        haa, hbb = haa + 1e-6, hbb + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a - scale * da, b - scale * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return (a, b) if a > 0 else (0.0, math.log(rate / (len(scored) - rate)))  # scores that tell nothing on held-out rows


def posteriors(docs: DataFrame, labels: DataFrame, bounds: Fit = Fit()) -> DataFrame:
    """``doc_id, n_tokens, high, low, toxic`` for every row of ``docs``: words of the whole text, and chances that add up to 1.

    The classifier learns from at most ``bounds.labelled`` labelled documents, taken by a hash of the
    id; only their ids, scores and labels, and the features (``_weights``), come to the driver. Chances
    are calibrated on held-out folds: each labelled text is scored by weights learned without its fold.
    A document is scored in its row, without a shuffle, by those of its distinct features that have
    weights. Conflicting labels of one id count as toxic, or as low; rows with a null label are left
    out. Null or empty texts have no tokens and the chances that their missing features give. With no
    labels all chances come from scores of 0. Repeated rows keep one row each; other columns, also of
    the names used here, are ignored, an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    known = (
        labels.filter("doc_id is not null and toxic is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"), F.min("quality").alias("good"))
        .orderBy(F.xxhash64("doc_id", F.lit(_SEED)), "doc_id")
        .limit(bounds.labelled)
    )
    known = cut(known, "labelled")
    # One row for each text, and copies in one fold: else copies of one document would pass for evidence.
    seen = docs.join(F.broadcast(known), "doc_id").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    seen = seen.groupBy("h").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"), F.min("good").alias("good"))
    seen = seen.withColumn("fold", F.pmod(F.xxhash64("h", F.lit(_SEED)), F.lit(bounds.folds)).cast("int"))
    learned = cut(_marked(seen).select("fold", *LABELS, "marks"), "learned")
    weights = _weights(learned, bounds)
    held = F.lit(0.0)
    chance = {}
    for x in LABELS:
        held = F.lit(0.0)
        for f in range(bounds.folds):
            held = F.when(F.col("fold") == f, _score(F.col("marks"), weights[f, x])).otherwise(held)
        # A row for each labelled one, bounded as these are: counts by score and label.
        rows = learned.select(F.round(held, 6).alias("s"), F.col(x).alias("y")).collect()
        a, b = _calibrate([(r["s"], r["y"]) for r in rows])
        chance[x] = 1 / (1 + F.exp(-(F.lit(a) * F.col(f"{x}_s") + b)))
    rows = computed_once(_marked(docs), **{f"{x}_s": _score(F.col("marks"), weights[None, x]) for x in LABELS})
    return rows.select(
        "doc_id", "n_tokens",
        ((1 - chance["toxic"]) * chance["good"]).alias("high"),
        ((1 - chance["toxic"]) * (1 - chance["good"])).alias("low"),
        chance["toxic"].alias("toxic"),
    )


def _solved(m: list[list[float]]) -> list[list[float]]:
    """The inverse of a small symmetric matrix with a ridge, by elimination."""
    k = len(m)
    ridge = 1e-9 * max([1e-12, *(m[i][i] for i in range(k))])
    rows = [[m[i][j] + ridge * (i == j) for j in range(k)] + [float(i == j) for j in range(k)] for i in range(k)]
    for i in range(k):
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(k):
            if j != i:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
    return [r[k:] for r in rows]


def fit_rates(docs: DataFrame, weights: dict[str, float], total: float | None = None, max_rate: float | None = None, steps: int = 40, tol: float = 1e-6, damping: float = 0.02) -> DataFrame:
    """Add ``rate`` to rows of ``n_tokens`` and one column of chances per domain in ``weights`` (null chances count as 0).

    Minimises the squared gap between ``sum(rate * n_tokens * chance)`` and ``weight * total`` over the
    domains (total: tokens of all rows), from rate 1, with rates at least 0 (and at most ``max_rate``).
    One step is one pass that returns a sum per domain; the gradient of a row is made from its own
    chances and those sums. Steps are preconditioned by the domain-by-domain moments of the rows whose
    rate is free to move, plus ``damping`` times those of all rows, and stop when sums move less than
    ``tol`` of the total, or after ``steps``. Rows without tokens keep rate 1.
    """
    names, scale = list(weights), sum(weights.values()) or 1.0
    n = F.col("n_tokens")
    docs = docs.fillna(0.0, subset=names).fillna(0, subset=["n_tokens"])
    cells = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    first = docs.agg(F.sum(n), *(F.sum(n * F.col(names[i]) * F.col(names[j])) for i, j in cells)).first()
    tokens = float(first[0] or 0)
    if not tokens:
        return docs.withColumn("rate", F.lit(1.0))

    def square(values: list) -> list[list[float]]:
        out = [[0.0] * len(names) for _ in names]
        for (i, j), x in zip(cells, values):
            out[i][j] = out[j][i] = x or 0.0
        return out

    every, goal = square(first[1:]), [weights[d] / scale * (tokens if total is None else total) for d in names]
    held = docs.withColumn("rate", F.lit(1.0 if max_rate is None else min(1.0, max_rate)))
    rate, last = F.col("rate"), None
    free = rate > 0 if max_rate is None else (rate > 0) & (rate < max_rate)
    for k in range(steps):
        inside = (F.sum(F.when(free, n * F.col(names[i]) * F.col(names[j]))) for i, j in cells)
        row = held.agg(*(F.sum(rate * n * F.col(d)) for d in names), *inside).first()
        sums, moment = [x or 0.0 for x in row[: len(names)]], square(row[len(names) :])
        if last and max(abs(x - y) for x, y in zip(sums, last)) < tol * tokens:
            break
        last, gap = sums, [x - y for x, y in zip(sums, goal)]
        metric = [[f * (k > 0) + (damping if k else 1.0) * e for f, e in zip(*r)] for r in zip(moment, every)]
        inverse = _solved(metric)
        pull = [sum(inverse[i][j] * gap[j] for j in range(len(names))) for i in range(len(names))]
        moved = rate - sum((F.lit(g) * F.col(d) for g, d in zip(pull, names)), F.lit(0.0))
        moved = F.greatest(F.lit(0.0), moved if max_rate is None else F.least(F.lit(float(max_rate)), moved))
        held = held.withColumn("rate", F.when(n > 0, moved).otherwise(rate))
        if k % 8 == 7:
            held = cut(held, "rates")
    return held


def reached(rated: DataFrame, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """``domain, target, reached``: the tokens of each domain that rates were to give and do give, as shares of ``total``."""
    scale, n = sum(weights.values()) or 1.0, F.col("n_tokens")
    row = rated.agg(F.sum(n).alias("n"), *(F.sum(F.col("rate") * n * F.col(d)).alias(d) for d in weights)).first()
    base = (float(row["n"] or 0) if total is None else total) or 1.0
    return rated.sparkSession.createDataFrame([(d, w / scale, float(row[d] or 0) / base) for d, w in weights.items()], "domain string, target double, reached double")


def reachable(posterior: DataFrame, weights: dict[str, float], max_rate: float) -> float:
    """The most tokens of which all domains can have their share at rates of at most ``max_rate``: no domain asks for more than there is."""
    have = posterior.agg(*(F.sum(F.col("n_tokens") * F.col(d)) for d in weights)).first()
    scale = sum(weights.values()) or 1.0
    return min((max_rate * float(h or 0) * scale / w for h, w in zip(have, weights.values()) if w > 0), default=0.0)


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total: float | None = None, max_rate: float | None = None) -> DataFrame:
    """``doc_id, n_tokens, high, low, toxic, rate`` for every row of ``docs``; see ``posteriors`` and ``fit_rates``.

    With ``max_rate`` and no ``total``, targets are shares of what is ``reachable``.
    """
    posterior = cut(posteriors(docs, labels), "posteriors")
    if max_rate is not None and total is None:
        total = reachable(posterior, weights, max_rate)
    return fit_rates(posterior, weights, total, max_rate)

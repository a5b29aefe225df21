"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

Every document gives a vector of transformed statistics. For each language and source a minimum-covariance-
determinant estimate is found by concentration steps: from a robust start, the rows nearest to the centre
(by Mahalanobis distance) give the next centre and covariance, until its determinant falls no more. Each
step is one aggregation: distances are put into bins, and every bin carries the sums that a mean and a
covariance need, so the nearest rows are whole bins and no row is sorted or moved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lograft.llm.common import cut, words
from lograft.operators.cleaning import computed_once

#: Chi-squared quantiles of five degrees of freedom: at the share of rows that the estimate rests on, and at 1 - 1e-7.
_AT_COVERAGE, _FAR = 6.6257, 42.05
_SYMBOLS = r"[#*$%&|<>]"
#: Words in a window that counts as repeated.
_WINDOW = 5


@dataclass(frozen=True)
class Fit:
    """``floor``: spread of each statistic below which differences mean nothing; its square is added to the variances.
    ``coverage``: share of a group's rows nearest to its centre that its estimate rests on (``_AT_COVERAGE`` belongs to it).
    ``prior``: weight, in rows, of the estimate of the whole language in that of one source; it fades as a source grows.
    ``cutoff``: squared distance beyond which a document goes. ``steps``: most concentration steps; ``tol``: relative change of
    all determinants that ends them. ``bins``: bins per doubling of one plus the squared distance.
    """

    floor: tuple[float, ...] = (0.5, 0.05, 0.05, 0.1, 0.1)
    coverage: float = 0.75
    prior: float = 200.0
    cutoff: float = _FAR
    steps: int = 12
    tol: float = 1e-6
    bins: int = 16


DIM = len(Fit.floor)
_X = [f"x{i}" for i in range(DIM)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]
_SUMS = ["n", *(f"s{i}" for i in range(DIM)), *(f"p{i}{j}" for i, j in _PAIRS)]
_GROUP = ["g_lang", "g_source", "g_leaf"]


# -- statistics ----------------------------------------------------------------------------------


def _repeated_words(h: Column) -> Column:
    """Words in windows whose hash stands twice or more in ``h``, the hashes of all windows in order."""
    held = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = lambda k, d: F.coalesce(F.get(s, k)["h"] == F.get(s, k + d)["h"], F.lit(False))
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.when(k > 0, same(k, -1)).otherwise(False) | same(k, 1))
        starts = F.sort_array(F.transform(again, lambda k: F.get(s, k)["i"]))
        first = F.struct(F.lit(-_WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, first, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(_WINDOW), p - a["last"])).alias("n")))["n"]

    # the sorted windows are bound to a name by transforming an array that holds only them
    bound = F.get(F.transform(F.array(held), covered), F.lit(0))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bound)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and ``n_lines``, lines that hold a word."""
    plain = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    listed = computed_once(plain, w=words("text"), lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    at = F.when(F.size("w") >= _WINDOW, F.sequence(F.lit(0), F.size("w") - _WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = computed_once(listed, h=F.transform(at, lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(_WINDOW)))))
    return hashed.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("h")).alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vector() -> list[Column]:
    """Length and length of words on a log scale, shares of symbols, of repeated lines and of repeated words by their roots."""
    n, share = F.greatest("n_words", F.lit(1)), lambda a, b: F.sqrt(a / F.greatest(b, F.lit(1)))
    parts = (
        F.log1p("n_words"), F.log(F.greatest("word_chars", F.lit(1)) / n), share(F.col("n_symbols"), F.col("word_chars")),
        share(F.col("n_dup_lines"), F.col("n_lines")), share(F.col("n_repeat_words"), n),
    )
    return [c.alias(x) for c, x in zip(parts, _X)]


# -- estimates -----------------------------------------------------------------------------------


def _matrix(at) -> Column:
    return F.array(*(F.array(*(at(i, j) for j in range(DIM))) for i in range(DIM)))


def _inverted(m: str) -> str:
    """Inverse and determinant of a positive definite matrix column, by Gauss and Jordan over arrays."""
    unit = f"transform({m}, (r, i) -> concat(r, transform(sequence(0, {DIM - 1}), j -> if(i = j, 1D, 0D))))"
    step = (
        "(a, k) -> named_struct('det', a.det * a.m[k][k], 'm', transform(a.m, (r, i) -> "
        "if(i = k, transform(r, x -> x / a.m[k][k]), transform(r, (x, j) -> x - r[k] * a.m[k][j] / a.m[k][k]))))"
    )
    done = f"a -> named_struct('det', a.det, 'inv', transform(a.m, r -> slice(r, {DIM + 1}, {DIM})))"
    return f"aggregate(sequence(0, {DIM - 1}), named_struct('det', 1D, 'm', {unit}), {step}, {done})"


def _with_inverse(estimates: DataFrame) -> DataFrame:
    return computed_once(estimates, solved=F.expr(_inverted("cov"))).select("*", "solved.det", "solved.inv").drop("solved")


def _distance(at) -> Column:
    """The squared Mahalanobis distance of ``x`` from ``centre``, with ``at(i)`` the difference in place i."""
    terms = ((1 if i == j else 2) * F.get(F.get("inv", F.lit(i)), F.lit(j)) * at(i) * at(j) for i, j in _PAIRS)
    return F.greatest(sum(terms, F.lit(0.0)), F.lit(0.0))


def _off(i: int) -> Column:
    return F.col(_X[i]) - F.get("centre", F.lit(i))


def _same_group(estimates: DataFrame) -> tuple[DataFrame, Column]:
    """Estimates under other names, and the test that a row is of their group; null is a group too."""
    named = estimates.withColumnsRenamed({c: f"e_{c}" for c in _GROUP})
    test = F.lit(True)
    for c in _GROUP:
        test = test & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    return named, test


def _joined(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with the estimates of their groups. These are written tables of one small row a group, so Spark
    broadcasts them below its threshold; beyond it, adaptive execution splits the groups that are too large."""
    named, test = _same_group(estimates)
    return rows.join(named, test).drop(*(f"e_{c}" for c in _GROUP))


def _moments() -> list[Column]:
    sums = [F.sum(F.col(x)).alias(f"s{i}") for i, x in enumerate(_X)]
    return [F.count("*").alias("n"), *sums, *(F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"p{i}{j}") for i, j in _PAIRS)]


def _from_sums(fit: Fit) -> tuple[Column, Column]:
    """Centre and covariance of the rows that were summed, with the floors on the diagonal."""
    mean = lambda i: F.col(f"s{i}") / F.col("n")

    def cov(i: int, j: int) -> Column:
        i, j = max(i, j), min(i, j)
        return F.col(f"p{i}{j}") / F.col("n") - mean(i) * mean(j) + F.lit(fit.floor[i] ** 2 if i == j else 0.0)

    return F.array(*map(mean, range(DIM))), _matrix(cov)


def _starts(rows: DataFrame, fit: Fit) -> DataFrame:
    """Two robust starts a group: medians with quartile ranges, and with these and the correlation of squashed deviations."""
    parts = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    marks = rows.groupBy(*_GROUP).agg(*(F.percentile_approx(x, parts, 1000).alias(f"q_{x}") for x in _X))
    spread = lambda i: F.sqrt(((F.col(f"q_{_X[i]}")[2] - F.col(f"q_{_X[i]}")[0]) / 1.349) ** 2 + fit.floor[i] ** 2)
    centres = marks.select(*_GROUP, F.array(*(F.col(f"q_{x}")[1] for x in _X)).alias("centre"), F.array(*map(spread, range(DIM))).alias("spread"))
    centres = cut(centres, "centres")
    plain = centres.select(*_GROUP, F.lit(0).alias("start"), "centre", _matrix(lambda i, j: F.get("spread", F.lit(i)) ** 2 if i == j else F.lit(0.0)).alias("cov"))
    squashed = _joined(rows, centres).select(*_GROUP, "centre", "spread", *(F.tanh(_off(i) / F.get("spread", F.lit(i))).alias(_X[i]) for i in range(DIM)))
    sums = squashed.groupBy(*_GROUP).agg(*_moments(), F.first("centre").alias("centre"), F.first("spread").alias("spread"))
    unit = Fit(floor=(0.1,) * DIM)
    bent = sums.withColumn("c", _from_sums(unit)[1])
    scaled = _matrix(lambda i, j: F.get(F.get("c", F.lit(i)), F.lit(j)) * F.get("spread", F.lit(i)) * F.get("spread", F.lit(j)))
    return _with_inverse(plain.unionByName(bent.select(*_GROUP, F.lit(1).alias("start"), "centre", scaled.alias("cov"))))


def _concentrated(rows: DataFrame, estimates: DataFrame, fit: Fit) -> DataFrame:
    """The estimates that the nearest rows give, with ``reach``, the squared distance up to which rows were taken."""
    near = computed_once(_joined(rows, estimates), d2=_distance(_off))
    binned = near.groupBy(*_GROUP, "start", F.floor(F.log2(1 + F.col("d2")) * fit.bins).alias("bin")).agg(*_moments())
    own = Window.partitionBy(*_GROUP, "start")
    upto = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    seen = binned.select("*", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(own).alias("all"))
    nearest = seen.filter(F.col("before") < F.ceil(fit.coverage * F.col("all"))).groupBy(*_GROUP, "start")
    sums = nearest.agg(*(F.sum(c).alias(c) for c in _SUMS), F.max("bin").alias("bin"), F.first("all").alias("all"))
    centre, cov = _from_sums(fit)
    reach = F.pow(F.lit(2.0), (F.col("bin") + 1) / fit.bins) - 1
    return _with_inverse(sums.select(*_GROUP, "start", centre.alias("centre"), cov.alias("cov"), reach.alias("reach"), "all"))


def estimate(rows: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """``g_lang, g_source, g_leaf, centre, cov, all``: the minimum-covariance-determinant estimate of every group of written ``rows``.

    Both starts are followed; the one with the lesser determinant is returned, scaled so that the distance within
    which its rows lie is that of a normal distribution.
    """
    now = cut(_starts(rows, fit).drop("cov"), "estimates")
    for k in range(fit.steps):
        after = cut(_concentrated(rows, now, fit), "estimates")
        named, test = _same_group(now.select(*_GROUP, F.col("start").alias("e_start"), F.col("det").alias("e_det")))
        change = after.join(named, test & (F.col("start") == F.col("e_start"))).agg(F.max(F.abs(F.col("det") / F.col("e_det") - 1))).first()[0]
        now = after
        if k and (change or 0.0) < fit.tol:
            break
    best = now.groupBy(*_GROUP).agg(F.min_by(F.struct("centre", "cov", "reach", "all"), F.struct("det", "start")).alias("b")).select(*_GROUP, "b.*")
    scale = F.greatest(F.col("reach") / _AT_COVERAGE, F.lit(1.0))
    return best.withColumn("cov", F.transform("cov", lambda r: F.transform(r, lambda x: x * scale))).drop("reach")


def _blended(estimates: DataFrame, fit: Fit) -> DataFrame:
    """Each source's estimate with that of its language as if it were of ``prior`` further rows; ready for distances."""
    whole = estimates.filter("not g_leaf").select(F.col("g_lang").alias("w_lang"), F.col("centre").alias("w_centre"), F.col("cov").alias("w_cov"))
    both = estimates.filter("g_leaf").join(whole, F.col("g_lang").eqNullSafe(F.col("w_lang")))
    own = F.col("all") / (F.col("all") + fit.prior)
    mixed = F.zip_with("centre", "w_centre", lambda a, b: own * a + (1 - own) * b)
    off = lambda i: F.get("centre", F.lit(i)) - F.get("w_centre", F.lit(i))
    part = lambda c, i, j: F.get(F.get(c, F.lit(i)), F.lit(j))
    cov = _matrix(lambda i, j: own * part("cov", i, j) + (1 - own) * part("w_cov", i, j) + own * (1 - own) * off(i) * off(j))
    return _with_inverse(both.select(*_GROUP, mixed.alias("centre"), cov.alias("cov"))).drop("cov", "det")


def judge(docs: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``kept`` and ``distance`` (squared, null where the fixed limits reject) of every document.

    A document is kept if it passes the fixed limits and lies within ``cutoff`` of its group's centre. Groups
    are languages with sources, null being a value of its own; they are estimated from all documents that pass
    the limits. Null and empty texts have no words and fail. A group of few rows is judged mostly by its
    language's estimate. Repeated rows count each and get the same verdict; an empty table gives an empty one.
    Other columns are not looked at. A very long text is judged whole.
    """
    stats = statistics(docs).withColumn("base_failed", base_failed())
    stats = cut(stats.select("*", *_vector()), "statistics")
    good = stats.filter("not base_failed")
    levels = F.array(F.struct(F.col("source").alias("g_source"), F.lit(True).alias("g_leaf")), F.struct(F.lit(None).cast("string").alias("g_source"), F.lit(False).alias("g_leaf")))
    grouped = good.select(F.col("lang").alias("g_lang"), F.inline(levels), *_X)
    final = cut(_blended(cut(estimate(grouped, fit), "best"), fit), "final")
    judged = _joined(good.select("*", F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.lit(True).alias("g_leaf")), final)
    judged = judged.withColumn("distance", _distance(_off)).withColumn("kept", F.col("distance") <= fit.cutoff)
    failed = stats.filter("base_failed").select("*", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return judged.select(*columns).unionByName(failed.select(*columns))

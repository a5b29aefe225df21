"""How filters interact: what each removes in every order, alone and by its Shapley share, exactly.

A document is reduced to the set of filters that it fails. Counting documents by part and set gives, for
each of the 32 coalitions of filters, how many documents it removes; steps of an order are differences of
two coalitions. Shapley values solve the kernel-weighted least squares fit of the coalitions' removals by
sums over filters, constrained to sum to what all filters remove. Its normal equations are solved once, in
rationals: the matrix depends on the number of filters alone.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.llm.common import cut, join_hot, screened, words
from lograft.operators.cleaning import computed_once

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
#: The bit of the filter that looks for copies.
COPY = 1 << FILTERS.index("E")


def shapley_matrix(n: int) -> list[list[Fraction]]:
    """Row f, column S (a set as bits): the share of the value of coalition S in the Shapley value of f.

    Minimises ``sum over 0 < |S| < n of w(|S|) (v(S) - sum of phi over S)^2`` with ``w(s) = (n - 1) / (C(n, s) s (n - s))``
    under ``sum of phi = v(all)``, by Lagrange: ``[A 1; 1' 0] [phi; mu] = [B v; v(all)]``, in rationals.
    """
    full = (1 << n) - 1
    weight = {s: Fraction(n - 1, comb(n, s) * s * (n - s)) for s in range(1, n)}
    left = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [[Fraction(0)] * (full + 1) for _ in range(n + 1)]
    for S in range(1, full):
        w, members = weight[S.bit_count()], [f for f in range(n) if S >> f & 1]
        for f in members:
            right[f][S] += w
            for g in members:
                left[f][g] += w
    for f in range(n):
        left[f][n] = left[n][f] = Fraction(1)
    right[n][full] = Fraction(1)
    for k in range(n + 1):
        pivot = next(r for r in range(k, n + 1) if left[r][k])
        left[k], left[pivot], right[k], right[pivot] = left[pivot], left[k], right[pivot], right[k]
        for r in range(n + 1):
            if r != k and left[r][k]:
                t = left[r][k] / left[k][k]
                left[r] = [a - t * b for a, b in zip(left[r], left[k])]
                right[r] = [a - t * b for a, b in zip(right[r], right[k])]
    return [[x / left[f][f] for x in right[f]] for f in range(n)]


def text_failures(text: Column, listed: Column) -> Column:
    """The bits of filters A to D for a text and its words."""
    count = lambda c: F.size(c).cast("long")
    tests = {
        "A": F.size(listed) < 200,
        "B": 100 * count(F.array_distinct(listed)) < 50 * count(listed),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return reduce(Column.__add__, (F.when(t, 1 << FILTERS.index(f)).otherwise(0) for f, t in tests.items()))


def _marked(docs: DataFrame) -> DataFrame:
    """``part, doc_id, d, mask`` of every document: a digest that stands for its text, and the bits of A to D; written."""
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    listed = computed_once(plain, w=words("text"))
    return cut(listed.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("d"), text_failures(F.col("text"), F.col("w")).alias("mask")), "marked")


def tally(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by language and by the set of filters that they fail.

    Copies are found by digest: of each text that repeats the least doc_id is known, and only rows of such
    texts meet it, those of very frequent texts by broadcast. Only rows whose id may be labelled are
    shuffled to the labels. What these two find is counted apart and added up, so no join keeps all rows.
    """
    rows = _marked(docs)
    repeated = rows.groupBy("d").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    repeated = cut(repeated, "repeated")
    flag = lambda c: F.max((F.col(c) == 1).cast("long")).alias({"quality": "good"}.get(c, c))
    known = labels.select("doc_id", "quality", "toxic").filter("quality = 1 or toxic = 1").groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    known = cut(known.na.fill(0, ["good", "toxic"]).filter("doc_id is not null"), "known")
    may = screened(rows.filter("doc_id is not null"), known.select(F.xxhash64("doc_id").alias("k")), F.xxhash64("doc_id"))
    told = cut(may.filter("maybe").drop("maybe").join(known, "doc_id"), "labelled")

    total = rows.count()
    copies = lambda df: join_hot(df, repeated, "d", total=total).filter("doc_id > first")
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def counted(df: DataFrame, n: Column, good: Column, toxic: Column, sign: int = 1) -> DataFrame:
        sums = (F.sum(sign * c).alias(name) for name, c in (("n", n), ("good", good), ("toxic", toxic)))
        return df.groupBy("part", "mask").agg(*sums)

    def moved(df: DataFrame, *what: Column) -> DataFrame:
        """Copies leave the set without E for the set with it."""
        found = cut(counted(copies(df), *what), "copies")
        back = found.select("part", "mask", *((-F.col(c)).alias(c) for c in ("n", "good", "toxic")))
        return found.withColumn("mask", F.col("mask") + COPY).unionByName(back)

    flags = (none, F.col("good"), F.col("toxic"))
    parts = (counted(rows, one, none, none), counted(told, *flags), moved(rows, one, none, none), moved(told, *flags))
    return reduce(DataFrame.unionByName, parts).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def coalitions(tallied: DataFrame) -> DataFrame:
    """``part, total`` and, for ``n``, ``good`` and ``toxic``, an array: how many documents coalition S removes, at place S.

    ``alone`` holds, at place S, how many documents fail the filters of S and no others.
    """
    each = tallied.select("*", F.explode(F.sequence(F.lit(0), F.lit(_ALL))).alias("S"))
    gone = F.col("mask").bitwiseAND(F.col("S")) != 0
    sums = each.groupBy("part", "S").agg(
        F.sum("n").alias("total"), *(F.sum(F.when(gone, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")),
        F.sum(F.when(F.col("mask") == F.col("S"), F.col("n")).otherwise(0)).alias("alone"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("S", "n", "good", "toxic", "alone")))  # 32 entries a part
    out = sums.groupBy("part").agg(F.first("total").alias("total"), ordered.alias("v"))
    return out.select("part", "total", *(F.col(f"v.{c}").alias(c) for c in ("n", "good", "toxic", "alone")))


def _steps() -> tuple[Column, Column]:
    """Every order and step: its name, place, filter, the bits before it, and the whole numbers that give its Shapley sum."""
    n = len(FILTERS)
    orders = factorial(n)
    share = shapley_matrix(n)
    factors = []
    for f in range(n):
        scaled = [orders * x for x in share[f]]
        assert all(x.denominator == 1 for x in scaled)
        factors.append(F.array(*(F.lit(int(x)).cast("long") for x in scaled)))
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            at = FILTERS.index(name)
            out.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(at).alias("f"), F.lit(before).alias("before")))
            before |= 1 << at
    return F.array(*out), F.array(*factors)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the module.

    ``kept`` after the step and ``removed`` by it; ``redundant`` fail its filter and were removed before;
    ``unique_fails`` fail its filter only; ``good_lost`` and ``toxic_lost`` are removed by it and labelled
    so; ``shapley`` is what its filter removes, summed over all orders. A null or empty text has no
    words and fails A, and E where a smaller id holds none too; null languages are the part ''. A null id is
    smaller than none and has no label; rows that repeat with their id are no copies of each other; ids
    labelled more than once count as good or toxic if any label says so. No documents give no rows.
    Other columns are not looked at.
    """
    steps, factors = _steps()
    parts = cut(coalitions(tally(docs, labels)), "coalitions")
    each = parts.select("*", factors.alias("factors"), F.explode(steps).alias("s")).select("*", "s.*")
    bit = F.expr("shiftleft(1, f)")
    after = F.col("before") + bit
    at = lambda c, S: F.get(F.col(c), S)
    lost = lambda c: at(c, after) - at(c, F.col("before"))
    share = F.aggregate(
        F.zip_with(F.get("factors", F.col("f")), F.col("n"), lambda a, b: a * b), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return each.select(
        "part", "filter_order", "step", (F.col("total") - at("n", after)).alias("kept"), lost("n").alias("removed"),
        (at("n", bit) - lost("n")).alias("redundant"), at("alone", bit).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), share.alias("shapley"),
    )

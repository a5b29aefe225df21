"""The filter audit against a walk over every document and order, and against the textbook Shapley sum."""

import random
from fractions import Fraction
from itertools import permutations
from math import factorial

from lograft.llm import audit
from tests.llm.helpers import docs, rows_of


def brute(rows, labels):
    """Each document through each order, one filter at a time."""
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    flag = {}
    for i, q, x in labels:
        old = flag.get(i, (0, 0))
        flag[i] = (old[0] or q == 1, old[1] or x == 1)
    seen = []
    for i, t, *lang in rows:
        text = t or ""
        w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if x]
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text))
        fails += "D" * any(c in "#$%&*|" for c in text) + "E" * (i is not None and i > first[text])
        seen.append(((lang or [None])[0] or "", fails, *(flag.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part in {s[0] for s in seen}:
        own = [s for s in seen if s[0] == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                alive = [s for s in own if not set(order[:k]) & set(s[1])]
                gone = [s for s in alive if f in s[1]]
                failing = [s for s in own if f in s[1]]
                sums[f] += len(gone)
                out[part, order, k + 1] = [len(alive) - len(gone), len(gone), len(failing) - len(gone), sum(s[1] == f for s in own), sum(s[2] for s in gone), sum(s[3] for s in gone)]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                out[part, order, k + 1].append(sums[f])
    return out


def test_least_squares_gives_shapley_weights():
    for n in (2, 3, 5):
        m = audit.shapley_matrix(n)
        for f in range(n):
            for S in range(1 << n):
                s = S.bit_count()
                if S >> f & 1:
                    want = Fraction(factorial(s - 1) * factorial(n - s), factorial(n))
                else:
                    want = -Fraction(factorial(s) * factorial(n - s - 1), factorial(n))
                assert S == 0 or m[f][S] == want


def test_audit(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["alpha", "beta", "Gamma", "DELTA", "x#", "eta|", "mu"] + [f"w{k}" for k in range(rng.choice([3, 400]))], k=rng.choice([0, 3, 150, 199, 200, 260]))) for _ in range(40)]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(160)]
    rows += [(200, None, "en"), (201, "", "en"), (None, texts[0], "en"), (None, None, None), (7, rows[7][1], "de"), (7, rows[7][1], "de"), (300, "   ", "fr"), (301, "wort " * 100_000, "fr"), (302, "wort " * 100_000, "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 210, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r[:3]): list(r[3:]) for r in rows_of(audit.audit(docs(spark, rows, extra=True), known))}
    assert got == brute(rows, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs(spark, []), none).count() == 0
    one = rows_of(audit.audit(docs(spark, [(1, "a", "en")]), none))
    assert len(one) == 600 and {r[9] for r in one if r[1][r[2] - 1] == "A"} == {120} and {r[9] for r in one if r[1][r[2] - 1] == "B"} == {0}

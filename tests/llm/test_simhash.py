import random

import xxhash

from lograft.llm import simhash
from lograft.llm.components import components
from tests.llm.helpers import docs, rows_of


def brute(text, n=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in low).split(" ") if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(prints):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "gämma", "δ", "e e", "zeta.", "ETA", "theta"]
    texts = [None, "", "   \n\t", "one", "One", "ÀB àb", "a b c d"]
    for _ in range(40):
        base = [rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 400))]
        texts.append(" ".join(base))
        if rng.random() < 0.7:
            near = base[:]
            near[rng.randrange(len(near))] = "changed"
            texts += ["\n".join(near), " ".join(base).upper()]
    df = docs(spark, [(i, t) for i, t in enumerate(texts)], extra=True)
    got = {r[0]: r[1:] for r in rows_of(simhash.near_groups(df))}
    prints = {i: brute(t) for i, t in enumerate(texts)}
    want = groups(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_links_cross_tiles(spark):
    """Chains of near fingerprints, dealt into tiles of very few rows."""
    rng = random.Random(9)
    prints = {rng.getrandbits(63) for _ in range(60)}
    for p in list(prints):
        for _ in range(5):
            p ^= 1 << rng.randrange(63) | 1 << rng.randrange(63)
            prints.add(p)
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = simhash.links(df, "fp", tile=2)
    roots = dict(rows_of(components(links, "a", "b")))
    want = groups({p: p for p in prints})
    assert {p: roots.get(p, p) for p in prints} == want


def test_null_and_repeated_ids(spark):
    df = docs(spark, [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "other words here now")])
    got = sorted(rows_of(simhash.near_groups(df)), key=repr)
    assert [r[2] for r in got if r[0] == 7] == [7, 7]
    assert sorted((r[2] for r in got if r[0] is None), key=str) == [7, None]


def test_empty(spark):
    assert simhash.near_groups(docs(spark, [])).count() == 0

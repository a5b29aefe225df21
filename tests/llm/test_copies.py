"""Near copies against a brute-force comparison of all shingle sets."""

import random

import corpus_pipeline as P
from lograft.llm import copies, simhash
from lograft.llm.components import components
from tests.llm.helpers import docs, rows_of


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or {" ".join(w)}


def brute(rows, share=0.8):
    """The least id reachable for each id, and the number of links between unlike sets."""
    sets, up, links = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}, 0

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both >= share * (len(sets[i]) + len(sets[j]) - both):
                links += sets[i] != sets[j]
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, links


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = ["", None, "a b", "A b", "a b c d e"]
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(30, 300))]
        texts.append(" ".join(base))
        for _ in range(3):
            base = base[:]
            for _ in range(rng.randrange(1, 1 + len(base) // 30 + 1)):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
    return list(enumerate(texts))


def test_against_brute_force(spark):
    rows = corpus()
    want, links = brute(rows)
    assert links > 60 and len(set(want.values())) > 60
    for tile in (1 << 23, 700):  # in one task, and in parts
        assert dict(rows_of(copies.near_copies(docs(spark, rows, extra=True), tile=tile))) == want


def test_stage_keeps_one_of_each_group(spark):
    rows = corpus()
    kept = P.keep_one_of_near(spark, docs(spark, rows), "")
    assert {r[0] for r in rows_of(kept)} == set(brute(rows)[0].values())


def test_null_and_repeated_ids_and_no_rows(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "other words here now")]
    got = sorted(rows_of(copies.near_copies(docs(spark, rows))), key=repr)
    assert [r[1] for r in got if r[0] == 7] == [7, 7]
    assert sorted((r[1] for r in got if r[0] is None), key=str) == [7, None]
    assert copies.near_copies(docs(spark, [])).count() == 0


def test_groups_of_many_parts(spark):
    """A chain of versions, copies of both its ends, and texts in between that are like neither."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    chain = [[word() for _ in range(80)]]
    for _ in range(24):
        chain.append(chain[-1][:])
        at = rng.randrange(77)
        chain[-1][at : at + 3] = [word() for _ in range(3)]
    texts = [" ".join(c) for c in chain]
    for end in (chain[0], chain[-1]):
        for k in range(30):
            texts.append(" ".join(end[: 80 - k % 6] + [word()]))
    texts += [" ".join(chain[0][:40] + c[30:70]) for c in chain[::3]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    want, _ = brute(rows)
    assert 1 < len(set(want.values())) < 20
    for tile, part in ((1 << 23, 1 << 18), (1 << 23, 1500), (3000, 1500)):
        assert dict(rows_of(copies.near_copies(docs(spark, rows), tile=tile, part=part))) == want


def test_stage_takes_candidates_from_fingerprints(spark, monkeypatch):
    """All groups of op2 are tied by fingerprints and then checked: equal fingerprints of unlike sets are no copies."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = corpus() + [(1000 + i, "x y z " * 60 + " ".join(word() for _ in range(8))) for i in range(5)]
    table = docs(spark, rows)
    of_op2 = {r["doc_id"]: r for r in simhash.near_groups(table).collect()}
    assert {of_op2[1000 + i]["component_id"] for i in range(5)} == {1000}
    nodes = spark.createDataFrame([(i, int(r["fingerprint"], 16) - (1 << 64) * (r["fingerprint"] > "7fffffffffffffff")) for i, r in of_op2.items()], "node long, fp long")
    tied = dict(rows_of(components(copies._near_prints(nodes, 3), "a", "b")))
    groups = {}
    for i, r in of_op2.items():
        groups.setdefault(r["component_id"], set()).add(tied.get(i, i))
    assert all(len(g) == 1 for g in groups.values()) and sum(len(g) for g in groups.values()) == len(set.union(*groups.values()))
    asked, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda prints, col, radius: asked.append(radius) or links(prints, col, radius))
    kept = {r[0] for r in rows_of(P.keep_one_of_near(spark, table, ""))}
    assert asked == [3] and kept == set(brute(rows)[0].values())


def test_stars_take_no_round(spark, monkeypatch):
    """Links that are stars from the start are returned without a contraction, others as before."""
    from lograft.llm import components as C

    rounds, stars = [], C._stars
    monkeypatch.setattr(C, "_stars", lambda *x: rounds.append(1) or stars(*x))
    star = spark.createDataFrame([(1, 5), (6, 1), (1, 6), (3, 9), (4, 4)], "a long, b long")
    assert sorted(rows_of(components(star, "a", "b"))) == [(5, 1), (6, 1), (9, 3)] and not rounds
    path = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 60), (40, 60)], "a long, b long")
    assert dict(rows_of(components(path, "a", "b"))) == {k: 0 for k in range(1, 21)} | {50: 40, 60: 40} and rounds


def test_rounds_plan_little(spark, monkeypatch):
    """What a round of ``components`` writes is planned once, not again inside the next step: the driver holds all plans."""
    from lograft.llm import components as C

    sizes, cut = [], C.cut
    lines = lambda df: df._jdf.queryExecution().executedPlan().treeString().count("\n")
    monkeypatch.setattr(C, "cut", lambda df, name: sizes.append(lines(df)) or cut(df, name))
    hub, path = [(0, k) for k in range(1, 1500)], [(k, k + 1) for k in range(2000, 2030)]
    got = dict(rows_of(components(spark.createDataFrame(hub + path, "a long, b long"), "a", "b")))
    assert got == {k: 0 for k in range(1, 1500)} | {k: 2000 for k in range(2001, 2031)}
    assert len(sizes) > 5 and max(sizes) < 120


def test_stage_writes_a_small_plan(spark):
    """Rows that go and rows that repeat are told apart in one join; repeated rows keep one, null ids too."""
    text = "one two three four five six seven eight"
    rows = [(None, text), (None, text), (7, text), (8, "other words that nobody else has here"), (8, "other words that nobody else has here"), (9, "third")]
    kept = P.keep_one_of_near(spark, docs(spark, rows), "")
    assert kept._jdf.queryExecution().executedPlan().treeString().count("\n") < 120
    assert sorted((r[0], r[1]) for r in rows_of(kept) if r[0]) == [(8, rows[3][1]), (9, "third")]
    assert [r[1] for r in rows_of(kept) if r[0] is None] == [text]

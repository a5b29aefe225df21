"""Decontamination against every 12-word window of two texts."""

import random
from itertools import combinations

from lograft.llm import decontaminate
from tests.llm.helpers import docs, rows_of


def brute(doc, item, wide=12):
    """The best window, then the first, of all that hold a seed at its place."""
    found = []
    for shift in range(-len(item), len(doc) + 1):
        same = [0 <= k + shift < len(doc) and doc[k + shift] == w for k, w in enumerate(item)]
        for s in range(len(item) - wide + 1):
            seeds = ((at, m) for m in decontaminate.MASKS for at in range(s, s + wide - len(m) + 1))
            if sum(same[s : s + wide]) >= 0.8 * wide and any(all(same[at + k] for k, c in enumerate(m) if c == "1") for at, m in seeds):
                found.append((-sum(same[s : s + wide]), shift + s, s))
    matched, doc_word, item_word = min(found)
    return -matched, doc_word, item_word


def test_any_two_substitutions_in_a_window(spark):
    """Only words 6 to 17 of the item stand in the document, two of them replaced."""
    item = [f"w{k}" for k in range(24)]
    cases = list(combinations(range(12), 2))
    rng = random.Random(7)
    rows = []
    for n, gone in enumerate(cases):
        part = [w if k not in gone else f"x{n}" for k, w in enumerate(item[6:18])]
        rows.append((n, " ".join([f"a{rng.randrange(10**9)}", *part, "z"])))
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for bound in (1_000_000, 0):
        got = {r[0]: r[2:] for r in rows_of(decontaminate.overlaps(docs(spark, rows), bench, broadcast_seeds=bound))}
        assert got == {n: brute(t.split(), item) for n, t in rows}


def test_memory_does_not_grow_with_items(spark):
    """Copies of items are matched once, and no query holds more than one block of them: every pair is found all the same."""
    rng = random.Random(8)
    items = [[f"v{rng.randrange(400)}" for _ in range(n)] for n in (30, 13, 12, 11, 6, 5, 3, 1)] + [[f"u{i}w{k}" for k in range(14)] for i in range(12)]
    rows = [(n, " ".join(["a", *t[n % 2 :], "z"])) for n, t in enumerate(items)] + [(500, " ".join(items[0] + items[1])), (501, "nothing here")]
    bench = spark.createDataFrame([(i + 1000 * c, " ".join(t)) for i, t in enumerate(items) for c in range(40)] + [(5000, " ".join(items[0])), (5000, " ".join(items[8]))], "item_id long, text string")
    got = {bound: decontaminate.overlaps(docs(spark, rows), bench, broadcast_seeds=bound) for bound in (1_000_000, 100, 0)}
    found = [{r[:2]: r[2:] for r in rows_of(df)} for df in got.values()]
    assert found[0] == found[1] == found[2] and all({(n, n + 1000 * c) for c in range(40)} <= set(found[0]) for n in (0, 2, 4, 8, 19))
    assert {(0, 5000), (8, 5000), (500, 0), (500, 39001)} <= set(found[0]) and not any(i == 501 for i, _ in found[0])
    for df in got.values():
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3


def test_contaminated_makes_no_row_for_each_item(spark):
    """The pipeline's stage drops the documents that overlap an item, and no plan of it meets documents with copies of items."""
    import corpus_pipeline
    from lograft.llm import common

    item = [f"w{k}" for k in range(14)]
    rows = [(n, " ".join([f"a{n}", *item, "z"]) if n % 3 else f"b{n} c") for n in range(30)] + [(None, " ".join(item)), (None, None), (1, "")]
    bench = spark.createDataFrame([(c, " ".join(item)) for c in range(200)] + [(None, " ".join(item)), (900, None)], "item_id long, text string")
    want = {r[0] for r in rows_of(decontaminate.overlaps(docs(spark, rows), bench))}
    for bound in (1_000_000, 0):
        got = rows_of(decontaminate.contaminated(docs(spark, rows), bench, broadcast_seeds=bound))
        assert {r[0] for r in got} == want == {n for n in range(30) if n % 3} | {None} and len(got) == len(want)
    taken, plain, keys = corpus_pipeline.table, common.table, corpus_pipeline._keys
    plans = []
    corpus_pipeline.table = lambda s, d, name: bench if name == "benchmark" else plain(s, d, name)
    corpus_pipeline._keys = lambda df, key: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keys(df, key)
    try:
        kept = corpus_pipeline.drop_contaminated(spark, docs(spark, rows), "")
        assert sorted((r["text"] for r in kept.collect()), key=str) == sorted((t for _, t in rows if not t or t.startswith("b")), key=str)
    finally:
        corpus_pipeline.table, corpus_pipeline._keys = taken, keys
    assert plans[0].count("Join") <= 2

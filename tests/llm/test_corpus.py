"""Decontamination, mixing, line templates and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lograft.llm import decontaminate, lines, mixing, simhash
from tests.llm.helpers import COLUMNS, docs, rows_of

VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("b", "d", "f", "g", "k", "l", "m", "n")]


def prose(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


# -- decontamination


def test_substitutions_are_tolerated(spark):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (30, 45, 20, 14, 7, 5)]
    clean = [(i, " ".join(prose(rng, 300))) for i in range(30)]
    leaked = []
    for k, item in enumerate(items[:4]):
        for j in range(6):
            near = list(item)
            for at in range(j, len(near), 7) if j else ():  # one word of seven
                near[at] = "other"
            text = prose(rng, 40) + near + prose(rng, 40)
            leaked.append((100 + 10 * k + j, " ".join(text).upper().replace(" ", ", ") if j == 2 else " ".join(text)))
    short = [(200, " ".join(prose(rng, 9) + items[4] + prose(rng, 9))), (201, " ".join(items[5])), (202, None), (203, ""), (204, "!!! ???")]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string").withColumn("seed", F.lit(0))
    df = docs(spark, clean + leaked + short + leaked[:1], extra=True)
    want = {(i, (i - 100) // 10) for i, _ in leaked} | {(200, 4), (201, 5)}
    for bound in (1_000_000, 0):
        got = decontaminate.overlaps(df, bench, broadcast_seeds=bound)
        assert {r[:2] for r in rows_of(got)} == want and got.count() == len(want)
    first = {r[:2]: r[2:] for r in rows_of(got)}[100, 0]
    assert first == (12, 40, 0)


def test_nothing_leaks_from_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(docs(spark, [(1, "a b c d e f g h")]), bench).count() == 0
    assert decontaminate.overlaps(docs(spark, []), bench).count() == 0


# -- mixing


def labelled(spark, n=600):
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(n):
        kind = rng.choices(("high", "low", "toxic"), (7, 2, 1))[0]
        w = prose(rng, rng.randrange(5, 120))
        w = [x + "%%%" for x in w] if kind == "low" else w
        if kind == "toxic":
            w[:: 4] = ["vile"] * len(w[::4])
        rows.append((i, " ".join(w)))
        if i % 2:
            marks.append((i, int(kind != "low"), int(kind == "toxic")))
    return rows, marks


def test_mixture_meets_targets(spark):
    rows, marks = labelled(spark)
    known = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    extra = [(900, None), (901, ""), (902, "vile " * 9), (902, "vile " * 9), (None, "katlo")]
    weights = {"high": 0.5, "low": 0.45, "toxic": 0.05}
    got = mixing.mix(docs(spark, rows + extra, extra=True), known, weights).collect()
    assert len(got) == len(rows) + len(extra)
    total = sum(r["n_tokens"] for r in got)
    for d, w in weights.items():
        assert abs(sum(r["rate"] * r["n_tokens"] * r[d] for r in got) / total - w) < 0.01
    assert all(r["rate"] >= 0 and abs(r["high"] + r["low"] + r["toxic"] - 1) < 1e-9 for r in got)
    truth = dict((m[0], "toxic" if m[2] else "high" if m[1] else "low") for m in marks)
    right = [max(mixing.DOMAINS, key=lambda d: r[d]) == truth[r["doc_id"]] for r in got if r["doc_id"] in truth]
    assert sum(right) / len(right) > 0.95
    assert {r["n_tokens"] for r in got if r["doc_id"] in (900, 901)} == {0}


def test_solution_is_the_least_squares_one(spark):
    """Against plain projected gradient steps on the same problem."""
    rng = random.Random(2)
    data = []
    for i in range(40):
        p = [rng.random() ** 3 + 1e-3 for _ in range(3)]
        data.append((i, rng.randrange(1, 50), *(x / sum(p) for x in p)))
    df = spark.createDataFrame(data, "doc_id long, n_tokens long, high double, low double, toxic double")
    for cap in (None, 1.0):
        got = mixing.fit_rates(df, {"high": 0.2, "low": 0.8, "toxic": 0.0}, max_rate=cap, steps=60).collect()
        n = sum(r["n_tokens"] for r in got)
        goal = (0.2 * n, 0.8 * n, 0.0)
        loss = lambda rates: sum((sum(r * d[1] * d[2 + k] for r, d in zip(rates, data)) - goal[k]) ** 2 for k in range(3))
        best = [1.0] * len(data)
        step = 0.5 / sum(d[1] ** 2 for d in data)
        for _ in range(20_000):
            gap = [sum(r * d[1] * d[2 + k] for r, d in zip(best, data)) - goal[k] for k in range(3)]
            best = [min(cap or 1e9, max(0.0, r - 2 * step * d[1] * sum(g * d[2 + k] for k, g in enumerate(gap)))) for r, d in zip(best, data)]
        rates = [r["rate"] for r in sorted(got, key=lambda r: r["doc_id"])]
        assert loss(rates) <= loss(best) * 1.1 + 1e-3 * n * n


def test_mixing_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs(spark, [(1, "a b"), (2, None)]), none, P.MIX).collect()
    assert len(got) == 2
    assert mixing.mix(docs(spark, []), none, P.MIX).count() == 0


# -- line templates


def test_templates(spark):
    rng = random.Random(3)
    head = "served request number {} for user {} from the main site in {} ms"
    rows = [(i, "\n".join([" ".join(prose(rng, 12)), head.format(i, rng.choice(VOCABULARY), i * 7), "", " ".join(prose(rng, 9)), "all rights reserved."])) for i in range(12)]
    rows += [(50, "only here"), (51, None), (52, ""), (53, "all rights reserved.\nall rights reserved."), (None, "\n\n"), (54, "x " * 50_000)]
    got = {r[0]: r[1:] for r in rows_of(lines.drop_lines(docs(spark, rows, extra=True)))}
    for i, t in rows[:12]:
        a, _, blank, b, _ = t.split("\n")
        assert got[i] == (5, 2, "\n".join([a, blank, b]))
    assert got[50] == (1, 0, "only here") and got[51] == (0, 0, None) and got[52] == (1, 0, "") and got[53] == (2, 2, "") and got[None] == (3, 0, "\n\n")
    assert lines.drop_lines(docs(spark, [])).count() == 0


def test_copies_of_one_row_are_one_document(spark):
    assert {r[2] for r in rows_of(lines.drop_lines(docs(spark, [(1, "same line")] * 30)))} == {0}
    assert {r[2] for r in rows_of(lines.drop_lines(docs(spark, [(i, "same line") for i in range(30)])))} == {1}


# -- pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    sf = str(tmp_path_factory.mktemp("sf"))
    rows, marks = labelled(spark, 300)
    bench = " ".join(prose(rng, 40))
    full = [(i, t, "en" if i % 3 else None) for i, t in rows]
    full += [(1000, rows[5][1], "en"), (1001, rows[5][1].upper(), None), (1002, " ".join(prose(rng, 30)) + " " + bench, "en"), (1003, None, None), (1004, "123 456", "en"), (1005, "", None)]
    full += [(1006, "katlo mined " * 3, "en")] * 2 + [(None, " ".join(prose(rng, 25)), None)]
    docs(spark, full).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, full, marks


def test_stages(spark, corpus):
    sf, full, marks = corpus
    df, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        df = P.cut(out, "t")
        kept.append(sorted(rows_of(df), key=repr))
    ids = [{r[0] for r in k} for k in kept]
    assert not ids[0] & {1003, 1004, 1005} and len(kept[0]) == len(full) - 3
    groups = {r[0]: r[2] for r in rows_of(simhash.near_groups(docs(spark, [r[:2] for r in kept[0] if r[0] is not None])))}
    assert ids[1] == {None} | set(groups.values()) and len(kept[1]) == len(ids[1])
    assert 5 in ids[1] and not ids[1] & {1000, 1001}
    assert ids[1] - ids[2] == {1002}
    toxic, good = {m[0] for m in marks if m[2]}, {m[0] for m in marks if not m[2] and m[1]}
    assert not ids[3] & toxic and len(ids[2] & good - ids[3]) <= 0.02 * len(good)
    last = P.STAGES[-1][1](spark, df, sf)
    assert sorted(r[0] or -1 for r in rows_of(last)) == sorted(r[0] or -1 for r in kept[-1])
    assert sorted(rows_of(P.run(spark, sf)), key=repr) == sorted(rows_of(last), key=repr)


def test_empty_corpus(spark, tmp_path):
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0

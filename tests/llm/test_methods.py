"""Operators against plain versions of what they promise."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from lograft.llm import chat, decontaminate, language, lines, mixing, pii, sharding, topk
from lograft.llm.common import cut, join_hot, scratch, screened
from pyspark.sql import functions as F
from tests.llm.helpers import docs, rows_of

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("b", "d", "f", "g", "k", "l", "m", "n")]


# -- what operators share


def test_hot_keys_and_screens_lose_nothing(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 700).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n")).filter("k % 2 <> 0")
    for share in (0.001, 0.01, 1.0):
        got = join_hot(rows, keyed.withColumn("x", F.col("k") * 2), "k", share)
        assert got.count() == rows.filter("k % 2 <> 0").count() and got.filter("x <> 2 * k").count() == 0
    for bits in (8, 24):
        seen = screened(rows, keyed.select("k"), F.col("k"), bits)
        assert seen.count() == 5000 and seen.filter("k % 2 <> 0 and not maybe").count() == 0


def test_scratch_is_deleted(spark, tmp_path):
    with scratch(spark):
        path = cut(spark.range(3), "x").inputFiles()[0]
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


# -- chat


def test_messages_exist_only_after_the_fold(spark):
    rows = [(1, 0, "user", "one text that is told in pieces"), (1, 1, "assistant", "another one"), (1, 1, "assistant", "another one"), (2, 0, None, None)] + [(3, k, "user", f"said {k} times") for k in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("msg", F.lit("x"))
    log = chat.events_of(df)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"delta", "edit", "regenerate"}
    assert log.join(df.filter("text <> ''"), ["conv_id", "text"]).count() == 0
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.fold(log.repartition(3)).collect()}
    assert got == {c: [(r or "", t or "") for k, _, r, t in rows if k == c] for c in (1, 2, 3)}


# -- line templates


def test_two_templates_in_one_leaf(spark):
    rng = random.Random(1)
    fill = lambda n: [rng.choice(WORDS) + rng.choice("xyz") for _ in range(n)]
    kinds = [(["start", "of", "one", "line"], fill(20)), (["start", "of", "one", "line"], fill(20))]
    rows = []
    for k, (head, body) in enumerate(kinds):
        for i in range(12):
            own = body[:]
            own[4] = f"{rng.choice(WORDS)}{'abcdefghijkl'[i]}"
            rows.append((100 * k + i, " ".join(head + own)))
    rows += [(500, " ".join(kinds[0][0] + fill(20))), (501, "start of one line")]
    got = {r[0]: r[2] for r in rows_of(lines.drop_lines(docs(spark, rows, extra=True)))}
    assert all(n == 1 for i, n in got.items() if i < 500) and got[500] == got[501] == 0


def test_variable_words_are_learned(spark):
    """Three variable words in three fields, a variable first word, and short lines whose end alone is free."""
    rng = random.Random(7)
    fill = lambda n: [rng.choice(WORDS) + rng.choice("xyz") for _ in range(n)]
    own = lambda k, i: f"{rng.choice(WORDS)}q{'abcdefghij'[i % 10]}{'abcd'[i // 10]}{'uvw'[k]}"
    body, later = fill(24), fill(10)
    rows = []
    for i in range(40):
        three = body[:]
        for k, p in enumerate((6, 13, 20)):
            three[p] = own(k, i)
        rows.append((i, "\n".join([" ".join(three), " ".join([own(0, i), *later]), " ".join(["we", "went", "home", "and", own(1, i), own(2, i)])])))
    got = {r[0]: (r[2], r[3]) for r in rows_of(lines.drop_lines(docs(spark, rows)))}
    assert all(got[i] == (2, t.split("\n")[2]) for i, t in rows)


def test_long_documents_are_linear(spark):
    rng = random.Random(2)
    body = "\n".join(f"{rng.choice(WORDS)} {rng.choice(WORDS)} {i % 7} end of a line" for i in range(40_000))
    rows = [(i, body + f"\nown {WORDS[i]}" + "q" * 200_000) for i in range(11)]
    assert {r[1:3] for r in rows_of(lines.drop_lines(docs(spark, rows)))} == {(40_001, 40_000)}


# -- decontamination


def test_short_items_and_all_their_errors(spark):
    """Items of 1 to 13 words with every choice of as many replaced words as the share allows."""
    from itertools import combinations
    from math import ceil

    items, rows, want = [], [], set()
    for n in range(1, 14):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        wide = min(n, 12)
        for e in range(wide - ceil(wide * 0.8) + 2):
            for gone in combinations(range(n), e):
                best = max(sum(k not in gone for k in range(s, s + wide)) for s in range(n - wide + 1))
                text = " ".join(["a", *(f"x{k}" if k in gone else w for k, w in enumerate(item)), "z"])
                rows.append((len(rows), text))
                want |= {(len(rows) - 1, n)} if best >= ceil(wide * 0.8) else set()
    bench = spark.createDataFrame([*items, (None, None), (99, "!!")], "item_id long, text string")
    got = rows_of(decontaminate.overlaps(docs(spark, [*rows, (None, "nothing here")], extra=True), bench))
    assert {r[:2] for r in got} == want and len(got) == len(want)


# -- language


def test_predictions_against_a_plain_version(spark):
    """Bundles made gram by gram, cosines one by one."""
    letters = language.Letters()
    base = np.random.default_rng(20).choice(np.array([-1, 1]), (language.CODES, language.DIMS))

    def bundle(text):
        code = [letters.codes[ord(c)] for c in f" {text.lower()} "]
        code = [c for k, c in enumerate(code) if c or not k or code[k - 1]]
        v = np.zeros(language.DIMS)
        for k in range(len(code) - 2):
            v += np.roll(base[code[k]], 2) * np.roll(base[code[k + 1]], 1) * base[code[k + 2]]
        return v / np.linalg.norm(v)

    rng = random.Random(3)
    train = [(i, " ".join(rng.choices(["the", "and", "cat", "dog"] if n == "en" else ["der", "und", "katze"], k=9)), n) for i in range(40) for n in ("en", "de")]
    rows = [*train, (900, "a cat and a dog"), (901, "katze und hund")]
    own = [(t, n) for i, t, n in train if zlib.crc32(str(i).encode()) % 4 != 2]
    sums = {n: sum(bundle(t) for t, m in own if m == n) for n in ("de", "en")}
    means = {n: s / np.linalg.norm(s) for n, s in sums.items()}
    center = sum(means.values()) / 2
    unit = lambda v: v / np.linalg.norm(v)
    for i, _, pred, score in rows_of(language.identify(docs(spark, rows))):
        text = next(t for j, t, *_ in rows if j == i)
        if i >= 900:
            c = {n: unit(bundle(text) - center) @ unit(m - center) for n, m in means.items()}
            assert pred == max(c, key=c.get) and abs(score - min(1, max(0, max(c.values())))) < 1e-4


def test_bundles_do_not_depend_on_how_texts_meet(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(500)) for _ in range(20)] + ["", None, "12"]
    whole = language.Letters().bundle(texts)
    monkeypatch.setattr(language, "_CELLS", 1000)
    assert np.allclose(whole, language.Letters().bundle(texts), atol=1e-6)
    assert language.Model(["a", "b"], np.array([np.ones(language.DIMS), np.zeros(language.DIMS)])).names == ["a"]


# -- top-k


def test_repeated_query_ids_and_overflow(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])]
    got = rows_of(topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2))
    assert sorted(got) == sorted([(0, 1, 1, 65536), (0, 2, 2, 32768), (0, 1, 1, 65536), (0, 2, 0, 0)])
    with pytest.raises(ValueError):
        topk.search(spark.createDataFrame([(0, [1e300]), (1, [1e300])], "vec_id long, embedding array<double>"))


# -- sharding


def test_shards_against_a_plain_version(spark):
    import hashlib
    import math

    def draw(key, name, weight):
        bits = int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 1) / 2**52) / weight

    def place(key, grown):
        regions = [("g0", 4), ("g1", 4)] + [("g+0", 1)] * grown
        g = min(regions, key=lambda r: draw(key, *r))[0]
        if g == "g+0":
            return 8
        first = int(g[1]) * 4
        r = min((0, 1), key=lambda r: draw(key, f"{g}/r{r}", 2))
        return min((first + 2 * r, first + 2 * r + 1), key=lambda s: draw(key, str(s), 1))

    rows = [(i * 7, "ä" * (i % 4) if i % 9 else None) for i in range(400)]
    got = rows_of(sharding.shard(docs(spark, rows)))
    count = {}
    for i, t in rows:
        r = next(x for x in got if x[0] == i)
        raw = (t or "").encode()
        s = place(str(i), 0)
        assert r[1:] == (len(raw) + 1, zlib.crc32(raw), "key", s, count.get(s, 0), place(str(i), 1))
        count[s] = count.get(s, 0) + 1


# -- personal data


def planted(rng):
    """Data in spellings that no strict pattern matches, and what only looks like it."""
    n = lambda k: "".join(rng.choices("0123456789", k=k))
    card = next(c for c in iter(lambda: "4" + n(15), "") if pii._luhn(c))
    dotted = ".".join(card[i : i + 4] for i in range(0, 16, 4))
    good = [
        ("card", f"card no {dotted} ok", dotted), ("card", f"{n(5)} {dotted} ok", dotted), ("email", "mail to jo.doe [at] host [dot] org now", "jo.doe [at] host [dot] org"),
        ("ip", f"server 10 . {rng.randrange(99)} . 7 . 21 is up", None), ("phone", f"call {n(3)}-{n(3)}-{n(4)} today", None), ("secret", f"api_key = '{rng.randbytes(16).hex()}' set", None),
    ]
    bad = [f"order {n(9)} came", f"on 2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} we met", f"version {n(1)}.{n(2)}.{n(1)} is out", "meet at ( noon ) there", f"commit {rng.randbytes(20).hex()} fixed it", f"page {n(2)} of {n(3)}"]
    return good, bad


def test_added_spans_on_planted_data(spark):
    rng = random.Random(9)
    fill = lambda: " ".join(rng.choices(WORDS, k=12))
    kinds = {}
    for size in (40, 400):  # the same kinds on at either size
        detector = pii.fit(docs(spark, [(i, fill()) for i in range(size)]))
        kinds[size] = set(detector.thresholds)
    assert kinds[40] == kinds[400] == set(pii.KINDS)
    hit = all_good = false = all_bad = 0
    for _ in range(60):
        good, bad = planted(rng)
        for kind, text, _ in good:
            found = [s for s in detector.spans(f"{fill()} {text} {fill()}")]
            all_good, hit = all_good + 1, hit + any(s[0] == kind and not s[3] for s in found)
        for text in bad:
            all_bad, false = all_bad + 1, false + bool(detector.spans(f"{fill()} {text} {fill()}"))
    assert hit >= 0.9 * all_good and false <= 0.05 * all_bad, (hit, all_good, false, all_bad)


def test_candidates_stay_linear():
    import time

    for unit in ("1 ", "12 345 ", "a@b.c ", "+1 743 555-3824 ", "abc123def456 ", "a.b@c.d."):
        began = time.time()
        assert len(pii.candidates(unit * 40_000)) < 400_000 and time.time() - began < 20
    detector = pii.Detector(pii.boost(np.zeros((0, 1)), np.zeros(0)), dict.fromkeys(pii.KINDS, 2.0))
    assert len([s for s in detector.spans("a@b.cd " * 20_000) if s[3]]) == 20_000


# -- mixing


def test_scores_against_a_plain_version(spark):
    weights = {"bad": 2.5, "b" * 9: -1.0, "%%": 0.5}
    rows = [(1, "Bad%% words, BAD."), (2, None), (3, "fine"), (4, "b" * 9)]
    got = dict(rows_of(mixing._marked(docs(spark, rows)).select("doc_id", mixing._score(F.col("marks"), weights))))
    want = {1: np.log1p(3.0), 2: 0.0, 3: 0.0, 4: -np.log1p(1.0)}
    assert all(abs(got[i] - want[i]) < 1e-12 for i in want)
    scored = [(0.1 * k, int(k > 20)) for k in range(40)]
    a, b = mixing._calibrate(scored)
    p = [1 / (1 + np.exp(-(a * s + b))) for s, _ in scored]
    assert a > 0 and abs(sum(p) - sum(y for _, y in scored)) < 1.0 and p[0] < 0.05 < 0.95 < p[-1]
    assert mixing._calibrate([(-s, y) for s, y in scored])[0] == 0.0 and mixing._calibrate([]) == (1.0, 0.0)


# -- pipeline


def test_stage_keys_against_a_plain_anti_join(spark):
    rows = [(i if i % 5 else None, f"text {i % 60}") for i in range(200)] + [(7, "text 7")] * 2
    df = docs(spark, rows)
    keyed = df.select(P._key().alias("key"), "text")
    gone = P._keys(keyed.filter("text like '%7'"), "key")
    assert sorted(rows_of(P._without(df, gone)), key=repr) == sorted((r for r in rows_of(df) if not r[1].endswith("7")), key=repr)

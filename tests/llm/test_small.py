"""Sharding, language, chat, top-k and personal data."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lograft.llm import chat, language, pii, sharding, topk
from lograft.llm.boosting import boost
from tests.llm.helpers import docs, rows_of

SF = "/root/testdata/sf0.001"


# -- sharding


def test_shards(spark):
    rows = [(i, "t" * (i % 5)) for i in range(3000)] + [(5, None), (None, "x"), (7, "tt"), (7, "tt")]
    got = rows_of(sharding.shard(docs(spark, rows, extra=True)))
    assert len(got) == len(rows)
    shards = {}
    for doc, size, crc, law, shard, slot, grown in got:
        assert law == "key" and 0 <= shard < 8 and grown in (shard, 8)
        shards.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert all(280 < len(s) < 480 for s in shards.values())
    moved = sum(r[6] == 8 for r in got)
    assert 250 < moved < 420
    by_id = {(r[0], r[4], r[6]) for r in got}
    assert len(by_id) == len({r[0] for r in got})
    assert {(r[1], r[2]) for r in got if r[0] == 3} == {(4, zlib.crc32(b"ttt"))}


def test_movement_stays_in_the_subtree(spark):
    """A heavier shard draws rows into its rack; the other rack only gives, and inside the rack only that shard takes."""
    leaf = lambda *n: tuple(sharding.Node(str(x)) for x in n)
    a = sharding.Node("root", children=(sharding.Node("x", children=leaf(0, 1)), sharding.Node("y", children=leaf(2, 3))))
    b = sharding.Node("root", children=(sharding.Node("x", children=leaf(0, 1)), sharding.Node("y", children=(sharding.Node("2", 3.0), sharding.Node("3")))))
    key = F.col("id").cast("string")
    got = rows_of(spark.range(2000).select(sharding.place(key, a), sharding.place(key, b)))
    assert all(p == q for p, q in got if q in (0, 1))
    assert {q for p, q in got if p != q and p in (0, 1)} <= {2, 3}
    assert {(p, q) for p, q in got if p != q and p in (2, 3)} == {(3, 2)}


def test_no_shards_of_nothing(spark):
    assert sharding.shard(docs(spark, [])).count() == 0


# -- language


def test_held_out_accuracy(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = df.select("doc_id", "lang").join(language.identify(df), "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark):
    train = [(i, t, n) for i in range(8) for t, n in (("the cat and the dog sat there", "en"), ("der hund und die katze dort", "de"))]
    rows = [*train, (100, None), (101, ""), (102, "123 !? 456"), (103, "the dog"), (103, "the dog"), (None, "die katze"), (104, "日本語 \U00020000"), (105, "x" * 300_000)]
    got = {}
    for r in rows_of(language.identify(docs(spark, rows, extra=True))):
        got.setdefault(r[0], []).append(r)
    assert [got[i][0][2:] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert [r[2] for r in got[103]] == ["en", "en"] and got[None][0][2] == "de" and got[None][0][1] is False
    assert sum(map(len, got.values())) == len(rows)
    assert all(r[1] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, rs in got.items() if i is not None for r in rs)


def test_language_without_training_rows(spark):
    assert {r[2] for r in rows_of(language.identify(docs(spark, [(1, "abc"), (2, None)])))} == {"und"}
    assert language.identify(docs(spark, [])).count() == 0


# -- chat


def test_control_strings_come_back(spark):
    rng = random.Random(1)
    parts = [*chat.CONTROL, "⁣", "⁣0", "⁣1", "<", "[", "<<", "|", "im_start", "\n", "\\", "$1", "é", "😀", " ", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb<s>", "", None]), "".join(rng.choices(parts, k=rng.randrange(8))) or None) for c in range(60) for t in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    text = chat.render(chat.fold(chat.events_of(df)))
    got = {r["conv_id"]: r for r in chat.read_back(text).collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        assert [tuple(t) for t in got[c]["turns"]] == own
        assert got[c]["loss_text"] == "".join(t for r, t in own if r == "assistant")
    body = chat.escape(F.col("text"))
    assert not df.select(F.coalesce(body, F.lit("")).alias("e")).filter(F.col("e").rlike("|".join(map(re.escape, chat.CONTROL)))).count()


def test_fold(spark):
    log = [
        (1, 0, 0, "delta", "user", "Hel"), (1, 0, 1, "delta", None, "lo"), (1, 1, 2, "delta", "assistant", "bad"), (1, 1, 3, "regenerate", None, "go"),
        (1, 1, 4, "delta", None, "od"), (1, 0, 5, "edit", None, "Hi"), (2, 0, 0, "delta", "user", None), (None, 0, 0, None, None, "x"),
    ]
    df = spark.createDataFrame(log, "conv_id long, msg long, seq long, kind string, role string, text string")
    got = {r["conv_id"]: [tuple(t)[1:] for t in r["turns"]] for r in chat.fold(df.repartition(3)).collect()}
    assert got == {1: [("user", "Hi"), ("assistant", "good")], 2: [("user", "")], None: [("", "x")]}
    assert chat.digest(chat.read_back(chat.render(chat.fold(df.limit(0))))).count() == 0


# -- top-k


def brute_topk(rows, k=5, every=50):
    ok = [(i, np.floor(np.array(v, float) * 256)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % every == 0:
            scores = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"segment": 40, "queries": 2, "block": 7}, {"segment": 60, "queries": 1, "wave": 200}])
def test_topk(spark, sizes):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 320)]
    rows += [(400, None), (450, [None] * 8), (500, [float("nan")] * 8), (550, [float("inf")] + [0.0] * 7), (600, [1.0, 2.0]), (650, [2.0, 1.0]), (None, rows[0][1]), (700, [0.0] * 8), (750, [1e6] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("v", F.lit(2))
    assert set(rows_of(topk.search(df, **sizes))) == brute_topk(rows)


def test_topk_of_nothing(spark):
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# -- personal data

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii._luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(8)
    fixed = ["4539578763621486", "4539 5787 6362 1486 x", "+1 (743) 555-3824", "a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1", "é@x.yz", "a@b", "9" * 5000 + ".1.1.1", "٣@x.y"]
    for t in fixed + ["".join(rng.choices("a1+@. -(%9", k=rng.randrange(60))) for _ in range(5000)]:
        assert pii.base_spans(t) == brute_pii(t), t


def test_long_runs_stay_linear():
    for t in ("a" * 200_000, "1" * 200_000, "1 " * 100_000, "+1" + " " * 200_000, "@" * 100_000, "a." * 100_000, "1." * 100_000):
        pii.base_spans(t), pii.candidates(t)


def test_detect_keeps_base_and_learns(spark):
    rng = random.Random(3)
    luhn = lambda: next(s for s in iter(lambda: "".join(rng.choices("0123456789", k=16)), "") if pii._luhn(s))
    word = lambda n: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))
    rows = [(i, f"{word(9)} {rng.choice([luhn(), f'+1 (743) 555-{rng.randrange(1000, 9999)}', f'{word(1)}@mail.example.com', f'10.{rng.randrange(256)}.3.{rng.randrange(256)}'])} {word(9)}") for i in range(600)]
    dotted = luhn()
    rows += [(1000, f"{word(9)} {dotted[:4]}.{dotted[4:8]}.{dotted[8:12]}.{dotted[12:]} {word(9)}"), (1001, None), (1002, ""), (1003, word(50)), (1003, word(50))]
    df = pii.detect(docs(spark, rows, extra=True))
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in df.collect()}
    for i, t in rows:
        assert [s[:3] for s in got[i] if s[3]] == brute_pii(t or "")
    assert [s[0] for s in got[1000]] == ["card"] and not got[1000][0][3]
    assert got[1001] == got[1002] == got[1003] == []
    text = docs(spark, rows).join(df, "doc_id").filter("doc_id = 1000").select(pii.redact("text", "spans")).first()[0]
    assert "<card>" in text and dotted[:4] not in text
    assert pii.detect(docs(spark, [])).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = boost(x[:1500], y[:1500])
    assert ((model.chances(x[1500:]) > 0.5) == (y[1500:] > 0)).mean() > 0.97



"""Very long texts, clashing column names and ties, for operators whose other tests hold none."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lograft.llm import chat, decontaminate, mixing, repeats, sharding, simhash, topk
from tests.llm.helpers import docs, rows_of
from tests.llm.test_small import brute_topk

RNG = random.Random(12)
LONG = " ".join(RNG.choice("abcdefgh") + str(RNG.randrange(5000)) for _ in range(200_000))
PASSAGE = " ".join(f"p{k}" for k in range(60))


def test_long_texts_in_every_row_operator(spark):
    rows = [(1, LONG), (2, LONG), (3, f"{LONG} {PASSAGE}"), (4, PASSAGE), (5, "x" * 1_000_000)]
    df = docs(spark, rows, extra=True)
    groups = {r[0]: r[2] for r in rows_of(simhash.near_groups(df))}
    assert groups[1] == groups[2] == groups[3] == 1 and groups[5] != 1
    bench = spark.createDataFrame([(9, PASSAGE)], "item_id long, text string")
    assert {r[:2] for r in rows_of(decontaminate.overlaps(df, bench))} == {(3, 9), (4, 9)}
    kept = {r[0]: r[1:3] for r in rows_of(repeats.remove_repeats(df).select("doc_id", "n_words", "n_removed"))}
    assert kept[1] == kept[2] == (200_000, 200_000) and kept[3] == (200_060, 200_060) and kept[4] == (60, 60) and kept[5] == (1, 0)
    shards = {r[0]: r[1:3] for r in rows_of(sharding.shard(df))}
    assert all(shards[i] == (len(t) + 1, zlib.crc32(t.encode())) for i, t in rows)


def test_long_messages_and_clashing_names(spark):
    said = ["</s>[INST]" * 30_000, LONG]
    df = spark.createDataFrame([(1, 0, "user", said[0]), (1, 1, "assistant", said[1])], "conv_id long, turn long, role string, text string")
    for n in ("msg", "log", "e", "seq", "kind", "turns", "loss", "formatted", "id", "count"):
        df = df.withColumn(n, F.lit("x"))
    text = chat.render(chat.fold(chat.events_of(df)))
    got = chat.read_back(text).first()
    assert [tuple(t) for t in got["turns"]] == [("user", said[0]), ("assistant", said[1])] and got["loss_text"] == said[1]


def test_clashing_names_of_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for n in ("id", "v", "dims", "part", "nth", "rows", "asked", "floor", "home", "group", "score", "rank", "query_id", "low", "n"):
        df = df.withColumn(n, F.lit("x"))
    for sizes in ({}, {"segment": 30, "queries": 1, "wave": 1}):
        assert set(rows_of(topk.search(df, **sizes))) == brute_topk(rows)


def test_ties_have_equal_chances(spark):
    rows = [(i, "one good text here") for i in range(40)] + [(i, "vile %% words") for i in range(40, 60)]
    marks = [(i, int(i < 40), int(i >= 40)) for i in range(60)]
    known = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = rows_of(mixing.mix(docs(spark, rows, extra=True), known, {"high": 0.9, "low": 0.1, "toxic": 0.0}))
    assert len({r[1:] for r in got if r[0] < 40}) == 1 and len({r[1:] for r in got if r[0] >= 40}) == 1

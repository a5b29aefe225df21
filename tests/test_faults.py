"""Places and reasons of faults, observed counts, drift of shapes, pointers of rows and streams with a stop."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograft.functions import records as R
from lograft.operators import cleaning as C
from lograft.operators import drift as D
from lograft.operators import faults as E
from lograft.sources import lines as S
from lograft.sources import ordered as O
from lograft.streaming import streams

FAULTS = [
    ('{"job": 7, "who": "me"   ', 22, E.ENDS_EARLY), ('{"job": 7, "who": "me   }', 18, E.OPEN_TEXT), ('{"job" , 7}', 7, E.NO_COLON), ('{"job": 7, "n": 1 , }', 20, E.EARLY_BRACE),
    ("{job: 7}", 1, E.NO_NAME), ('{"list": [1, "two"  ,  }', 23, E.EARLY_BRACE), ('{"list": [1 2]}', 12, E.NO_COMMA_ARRAY), ('{"list": [1}', 11, E.NO_COMMA_ARRAY), ('{"a": 1 "b": 2}', 8, E.NO_COMMA_OBJECT),
    ('{"a": 1]', 7, E.NO_COMMA_OBJECT), ("[1, ]", 4, E.EARLY_BRACKET), ("[,1]", 1, E.NO_VALUE), ('{"a":,"b":1}', 5, E.NO_VALUE), ('{"a": nul}', 6, E.NOT_A_VALUE), ('{"a": 01}', 6, E.NOT_A_VALUE),
    ('{"a": undefined}', 6, E.NOT_A_VALUE), ('{"a": "x\\q"}', 6, E.ODD_TEXT), ('{"a": "x\ty"}', 6, E.ODD_TEXT), ('{"é": tru}', 6, E.NOT_A_VALUE), ("just words", 0, E.NO_RECORD), ('"text"', 0, E.NO_RECORD), ("12", 0, E.NO_RECORD),
    ('{"a": 1, "a": 2}', None, E.OTHER), ("{", 1, E.ENDS_EARLY), ("[", 1, E.ENDS_EARLY), ('{"a', 1, E.OPEN_TEXT), ("{'a': 1}", 1, E.NO_NAME), ('{"a"}', 4, E.NO_COLON), ('{"a": {"b": [', 13, E.ENDS_EARLY), ('{"s": "' + "\\n" * 20_000, 6, E.OPEN_TEXT),
]


def test_places_and_reasons(spark):
    good = ["{}", '{"a":[1,{"b":null}],"c":"\\u00e9\\"","d":-1.5e+3}', "[[],[{}]] tail", "", "  "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([f[0] for f in FAULTS] + good)], "line_no long, line string")
    got = {r["line_no"]: (r["status"], r["error_at"], r["error_reason"]) for r in E.explain_bad(C.classify_lines(df)).collect()}
    for i, (line, at, reason) in enumerate(FAULTS):
        assert got[i][0] in C.BAD and got[i][1:] == (at, reason), line[:40]
    assert all(got[len(FAULTS) + k][1:] == (None, None) for k in range(len(good)))
    report = {r["error_reason"]: (r["lines"], r["first_line"], r["first_at"]) for r in E.fault_report(C.classify_lines(df.withColumn("source", F.lit("s"))), "line_no").collect()}
    assert report[E.NO_RECORD] == (3, 19, 0) and sum(r[0] for r in report.values()) == len(FAULTS)


def test_random_damage_is_found(spark):
    """Whatever is damaged, the text before the place told is the start of some record, where the reason is one of syntax."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        line = json.dumps({"a": [1, {"b": "x\\y"}], "c": None, "d": {"e": True, "f": [[], ["z"]]}})
        k = rng.randrange(len(line))
        line = rng.choice([line[:k], line[:k] + line[k + 1 :], line[:k] + rng.choice('{}[],:"x1 \\') + line[k:]])
        rows.append((i, line))
    seen = C.classify_lines(spark.createDataFrame(rows, "line_no long, line string"))
    for r in E.explain_bad(seen).collect():
        bad = r["status"] in C.BAD
        assert bad == (r["error_reason"] is not None)
        if bad and r["error_at"] is not None:
            try:
                json.loads(r["clean"])
                found = None
            except json.JSONDecodeError as e:
                found = e.pos
            assert found is None or abs(found - r["error_at"]) <= 2 or r["error_reason"] in (E.OPEN_TEXT, E.ODD_TEXT, E.NO_RECORD, E.ENDS_EARLY, E.NOT_A_VALUE, E.EARLY_BRACE, E.EARLY_BRACKET), r


def test_all_terminal_sequences_go(spark):
    kept = "{\"a\":\"b\"}"
    around = [("\x1b[1;31m", "\x1b[0m"), ("\x1b(B", ""), ("\x1bc", "\x1b="), ("\x1bPq#1\x1b\\", ""), ("\u009b1m", "\u009bm"), ("\x1b^note\x1b\\", "\x1b_x\u009c"), ("\u009d0;t\u009c", "\x1b]2;open"), ("\x1b#8", "\x1b[")]
    df = spark.createDataFrame([(a + kept + b,) for a, b in around] + [("é\u0085 ü",)], "line string")
    got = [r[0] for r in df.select(C.strip_ansi("line")).collect()]
    assert got == [kept] * len(around) + ["é\u0085 ü"]


def test_counts_are_observed_in_the_write(spark, tmp_path):
    rows = [(i, x) for i, x in enumerate(["{}", "[1]", "", "x", '{"a', "{a}", None])]
    seen, told = C.observed_quality(C.classify_lines(spark.createDataFrame(rows, "line_no long, line string")))
    seen.write.parquet(f"{tmp_path}/out")
    assert C.quality_row(spark, told).first().asDict() == {"record": 2, "blank": 2, "non_json": 1, "truncated": 1, "malformed": 1, "lines": 7, "invalid_utf8": 0}


def test_pointers_of_rows(spark):
    text = '{"a/b":[{"c~d":1}],"n":null,"o":{"0":"x","":{"k":[10,20]}},"l":["y",null],"~1":2}'
    cases = {"": None, "/a~1b/0/c~0d": "1", "/o/0": '"x"', "/l/0": '"y"', "/l/1": "null", "/n": "null", "/n/x": None, "/l/00": None, "/l/2": None, "/l/-": None, "/zz": None, "n": None, "/o//k/1": "20", "/~01": "2", "/": None, "/l/99999999999": None}
    df = spark.createDataFrame([(p,) for p in cases] + [(None,)], "p string").withColumn("v", F.parse_json(F.lit(text)))
    got = {r["p"]: (r["x"], r["y"]) for r in df.select("p", F.to_json(R.json_pointer_at("v", F.col("p"))).alias("x"), F.to_json("v").alias("y")).collect()}
    assert got[None][0] is None and got[""][0] == got[""][1]
    assert {p: x for p, (x, _) in got.items() if p} == {p: x for p, x in cases.items() if p}
    for p in cases:
        one = spark.range(1).select(F.to_json(R.json_pointer(F.parse_json(F.lit(text)), p))).first()[0]
        assert one == got[p][0]


def test_struct_of_a_variant_is_that_of_the_text(spark):
    lines = ['{"a":1,"b":{"c":"x","d":[1,null,2]},"e":null}', '{"a":"no number","b":{"c":5}}', "{}", "[1]", '{"b":7}', '{"b":{"d":["x"]}}']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r[0].asDict(True) if r[0] else None for r in df.select(R.struct_of(F.parse_json("line"), T.DataType.fromDDL("a long, b struct<c: string, d: array<long>>, e string"))).collect()]
    assert got[0] == {"a": 1, "b": {"c": "x", "d": [1, None, 2]}, "e": None} and got[2] == {"a": None, "b": None, "e": None}


def test_paths_of_shapes():
    shape = "OBJECT<`a b`: ARRAY<OBJECT<x: DECIMAL(3,1), `q``t`: ARRAY<VOID>>>, n: BIGINT, o: OBJECT<>, VOID: STRING, v: ARRAY<VARIANT>>"
    assert set(D.paths_of(shape)) == {
        ("$", "object"), ("$.a b", "array"), ("$.a b[]", "object"), ("$.a b[].x", "decimal"), ("$.a b[].q`t", "array"), ("$.a b[].q`t[]", "void"),
        ("$.n", "bigint"), ("$.o", "object"), ("$.VOID", "string"), ("$.v", "array"), ("$.v[]", "variant"),
    }
    assert D.paths_of("ARRAY<ARRAY<BIGINT>>") == [("$", "array"), ("$[]", "array"), ("$[][]", "bigint")]


def test_drift(spark, tmp_path):
    lines = ['{"a":1}', '{"a":"x","b c":{"d":[true]}}', '{"a":2}', "[1]", '{"a":null}', None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, line string").withColumn("v", F.try_parse_json("line"))
    whole = sorted(map(tuple, D.drift_state(df).collect()))
    assert ("$.a", "bigint", 2, 0, 2) in whole and ("$.a", "void", 1, 4, 4) in whole and ("$", "object", 4, 0, 4) in whole and ("$.b c.d[]", "boolean", 1, 1, 1) in whole
    halves = D.merged(D.drift_state(df.filter("line_no < 2")).unionByName(D.drift_state(df.filter("line_no >= 2"))))
    assert sorted(map(tuple, halves.collect())) == whole
    found = {tuple(r) for r in D.changes(D.drift_state(df.filter("line_no < 1")), D.drift_state(df.filter("line_no in (1, 3)"))).collect()}
    assert ("$.a", "string", "new") in found and ("$.a", "bigint", "gone") in found and ("$", "object", "new") not in found
    for k in range(3):
        df.filter(F.col("line_no") % 3 == k).select("line_no", "line").write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("line_no long, line string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    D.watch(stream, f"{tmp_path}/state", f"{tmp_path}/cp", lambda b: F.try_parse_json("line")).awaitTermination()
    assert sorted(map(tuple, D.merged(spark.read.parquet(f"{tmp_path}/state")).select(*D.drift_state(df).columns).collect())) == whole
    assert D.drift_state(df.limit(0)).count() == 0


@pytest.mark.parametrize("per_batch", [1, 2, None])
def test_stop_on_a_stream(spark, tmp_path, per_batch):
    """Files in several triggers, more after a restart: what is written is what the batch reader gives."""
    for folder, bad in (("x", (2, 7)), ("y", None), ("z", (0, 0))):
        os.makedirs(tmp_path / "in" / folder)
    def put(folder, f, bad):
        own = [f'{{"d":"{folder}","f":{f},"i":{i}}}' if (f, i) != bad else '{"cut' for i in range(20)]
        (tmp_path / "in" / folder / f"{f}.log").write_text("\n".join(own) + "\n")
        os.utime(tmp_path / "in" / folder / f"{f}.log", (time.time() - 1000 + f,) * 2)
    def run():
        lines = S.stream_log_lines(spark, f"{tmp_path}/in/*", per_batch)
        streams.strict_prefix(lines, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    for f in range(5):
        for folder, bad in (("x", (2, 7)), ("y", None), ("z", (0, 0))):
            put(folder, f, bad)
        if f == 2:
            run()
    run()
    got = sorted(r["line"] for r in spark.read.parquet(f"{tmp_path}/out").select("line").collect())
    want = sorted(r["line"] for d in "xyz" for r in O.strict_prefix_lines(spark, f"{tmp_path}/in/{d}").select("line").collect())
    assert got == want and len(got) == 47 + 100


def test_report_of_batches_is_the_batch_report(spark, tmp_path):
    rows = [(x,) for x in ["{}", "[1]", "", "x", '{"a', "{a}"] * 7]
    S.write_lines(spark.createDataFrame(rows, "line string").repartition(5), f"{tmp_path}/in", "line")
    streams.route(S.stream_log_lines(spark, f"{tmp_path}/in", 2), *(f"{tmp_path}/{n}" for n in ("good", "bad", "cp")), report=f"{tmp_path}/report").awaitTermination()
    told = spark.read.parquet(f"{tmp_path}/report")
    assert told.count() == 3 and tuple(told.agg(*(F.sum(n) for n in (*C.STATUSES, "lines"))).first()) == (14, 7, 7, 7, 7, 42)


def test_few_pieces_a_line(spark):
    """What is sound is passed over whole: the fold takes a few steps, wherever the fault is."""
    one = '"k":[1,{"x":"y","z":[]}],"t" : "u" , '
    lines = [("{" + one * 200 + "}", 1 + 200 * len(one)), ("{" + one * 100 + "1}", 1 + 100 * len(one)), ('{"a":"b":1,' + one + "}", 8), ('["b" :1,' + one + "]", 5), ('{"a":{"b":1} "c":1,"d":2}', 13), ('{"a":[1] [2]}', 9), ('{"a" {}}', 5), ("[{}{}]", 3)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(lines)], "i int, t string")
    got = df.select("i", E.fault_of("t").alias("f"), F.size(F.regexp_extract_all("t", F.lit(E._PIECE), F.lit(0))).alias("n")).orderBy("i").collect()
    assert [r["f"]["at"] for r in got] == [at for _, at in lines]
    assert [r["f"]["reason"] for r in got] == [E.EARLY_BRACE, E.NO_NAME, E.NO_COMMA_OBJECT, E.NO_COMMA_ARRAY, E.NO_COMMA_OBJECT, E.NO_COMMA_OBJECT, E.NO_COLON, E.NO_COMMA_ARRAY]
    assert max(r["n"] for r in got) < 12


def test_strict_reading_gives_every_record(spark):
    """A row for each record of the table, and the first bad line told."""
    from lograft import queries as Q

    seen = Q.classify_lines(spark, "/root/testdata/sf0.001")
    out = Q.strict_fail(spark, "/root/testdata/sf0.001")
    first = seen.filter(F.col("status").isin(*C.BAD)).orderBy("line_no").first()["status"]
    assert out.select("line_no").exceptAll(seen.filter("status = 'record'").select("line_no")).isEmpty()
    assert out.count() == seen.filter("status = 'record'").count()
    assert {(r["failed"], r["said"]) for r in out.collect()} == {(True, first)}

"""Lines, classification, variants and streams on small hand-made input."""

import pytest
from pyspark.sql import functions as F

from lograft.functions import records as R
from lograft.functions.paths import parse_path, variant_path
from lograft.operators import cleaning as C
from lograft.operators import normalize as N
from lograft.plans import layout as L
from lograft.sources import lines as S
from lograft.streaming import streams

LINES = [
    ('{"a": 1}', "record"), ("[1, 2]", "record"), ("", "blank"), (" \t ", "blank"), (None, "blank"), ('"str"', "non_json"), ("12", "non_json"),
    ("\x1b[31m{\"a\":1}\x1b[0m", "record"), (" {\"a\":1}\r", "record"), ('{"a": {"b": 1', "truncated"), ('{"a" 1}', "malformed"), ('{"a":1,"a":2}', "malformed"),
    ('{"a":1} tail', "record"), ("{'a':1}", "malformed"), ('{"a": undefined}', "malformed"), ("\x1b]0;title\x07{}", "record"),
]


def _lines(spark):
    return spark.createDataFrame([(i, "s", x) for i, (x, _) in enumerate(LINES)], "line_no long, source string, line string")


def test_classification(spark):
    got = {r["line_no"]: r["status"] for r in C.classify_lines(_lines(spark)).collect()}
    assert [got[i] for i in range(len(LINES))] == [s for _, s in LINES]


def test_parts_make_the_whole(spark):
    seen = C.classify_lines(_lines(spark))
    good, bad = C.split_valid_invalid(seen)
    blank = seen.filter("status = 'blank'").count()
    assert good.count() + bad.count() + blank == len(LINES)
    report = C.parse_quality_report(seen, "line_no").collect()
    assert sum(r["lines"] for r in report) == len(LINES)
    assert {r["status"]: r["first_line"] for r in report}["truncated"] == 9


def test_strict(spark):
    seen = C.classify_lines(_lines(spark))
    assert [r["line_no"] for r in C.strict_prefix(seen, ["line_no"]).collect()] == [0, 1]
    sound = seen.filter("line_no < 5")
    assert C.strict_prefix(sound, ["line_no"]).count() == 2 == C.strict_fail(sound).count()
    with pytest.raises(Exception, match="non_json line"):
        C.strict_fail(C.classify_lines(_lines(spark).coalesce(1))).collect()


def test_take(spark):
    assert [r["line_no"] for r in C.take_lines(_lines(spark), 4, ["line_no"]).collect()] == [0, 1, 2, 3]
    assert C.take_lines(_lines(spark), 0, ["line_no"]).count() == 0


def test_paths():
    assert parse_path("a.b[0].c") == ("a", "b", 0, "c") and parse_path("[0][1]") == (0, 1)
    assert variant_path(("a/b", 0, "c'd")) == "$['a/b'][0]['c\\'d']"


def test_truthiness(spark):
    cases = [
        ("null", False), ('""', False), ("false", False), ("0", False), ("-0", False), ("{}", False), ("[]", False), ('{"a":null}', False), ("[null]", False),
        ('"0"', True), ('"false"', True), ("1", True), ("true", True), ('{"a":0}', True), ("[0]", True), ("0.5", True),
    ]
    df = spark.createDataFrame([(i, f'{{"x":{x}}}') for i, (x, _) in enumerate(cases)], "i int, s string")
    got = df.select("i", R.truthy_variant(R.variant_field(F.parse_json("s"), "x", "variant")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [t for _, t in cases]


def test_pointer(spark):
    v = F.parse_json(F.lit('{"a/b":[{"c~d":1}],"n":null,"o":{"0":"x"},"l":["y"]}'))
    one = spark.range(1).select(
        *(F.to_json(R.json_pointer(v, p)).alias(k) for k, p in {"a": "/a~1b/0/c~0d", "o": "/o/0", "l": "/l/0", "m": "/zz", "bad": "n", "lead": "/l/00"}.items()),
        F.is_variant_null(R.json_pointer(v, "/n")).alias("null"),
    ).first()
    assert one.asDict() == {"a": "1", "o": '"x"', "l": '"y"', "m": None, "bad": None, "lead": None, "null": True}


def test_discovered_schema_keeps_unlike_types(spark):
    df = spark.createDataFrame([('{"a":1,"b":{"c":"x"}}',), ('{"a":"one","d":[1.5]}',)], "clean string")
    schema = R.discover_schema(df)
    assert set(schema.names) == {"a", "b", "d"}
    shown = [r[0] for r in df.select(F.to_json(R.parse_struct("clean", schema))).collect()]
    assert shown == ['{"a":1,"b":{"c":"x"}}', '{"a":"one","d":[1.5]}']


def test_discovered_names_stay_as_they_are(spark):
    lines = [('{"AVOIDED":1,"OBJECT<x":{"VOID":null,"q`t":"z"},"a b":[true]}',)]
    df = spark.createDataFrame(lines, "clean string")
    schema = R.discover_schema(df)
    assert set(schema.names) == {"AVOIDED", "OBJECT<x", "a b"}
    assert df.select(F.to_json(R.parse_struct("clean", schema))).first()[0] == '{"AVOIDED":1,"OBJECT<x":{"q`t":"z"},"a b":[true]}'
    arrays = spark.createDataFrame([("[1,2]",), ("[3]",)], "clean string")
    assert [list(r[0]) for r in arrays.select(R.parse_struct("clean", R.discover_schema(arrays))).collect()] == [[1, 2], [3]]
    assert R.discover_schema(df.limit(0)).names == []


def test_invalid_bytes_are_told_from_their_sign(spark):
    df = spark.createDataFrame([(0, bytearray(b'{"a":"\xff"}')), (1, bytearray('{"a":"\ufffd"}'.encode())), (2, bytearray(b"{}"))], "line_no long, b binary")
    seen = C.classify_lines(df.select("line_no", F.lit("s").alias("source"), F.col("b").cast("string").alias("line")))
    report = C.parse_quality_report(seen, "line_no").collect()
    assert [(r["lines"], r["invalid_utf8"], r["error_class"]) for r in report] == [(3, 1, None)]


def test_parsed_once(spark):
    seen = C.classify_lines(_lines(spark), parsed="v")
    assert seen.filter("(status = 'record') <> (v is not null)").count() == 0
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("tryParseJson") + plan.count("parseJson") <= 1 or plan.count("VariantExpressionEvalUtils") <= 1


def test_levels(spark):
    df = spark.createDataFrame([("INFO",), ("warn",), ("Info",), (None,), ("NOTICE",)], "level string")
    got = df.select(N.severity("level"), N.severity_rank("level"), N.pad_level("level")).collect()
    assert [tuple(r) for r in got] == [("INFO", 2, " INFO"), ("WARN", 3, " warn"), (None, None, " Info"), (None, None, None), (None, None, "NOTICE")]


def test_files_and_streams_agree(spark, tmp_path):
    df = _lines(spark).filter("line is not null").repartition(3)
    S.write_lines(df, f"{tmp_path}/in", "line")
    batch = C.classify_lines(S.read_log_lines(spark, f"{tmp_path}/in"))
    assert batch.count() == len(LINES) - 1
    streams.run_available(S.stream_log_lines(spark, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    streamed = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, streamed.select("line", "status").collect())) == sorted(map(tuple, batch.select("line", "status").collect()))
    shown = lambda df: N.normalize_log(df.filter("status = 'record'").withColumn("r", R.parse_struct("clean", "a long, level string"))).select("line", "level", "data")
    render = lambda df: L.default_render(df.filter("status = 'record'").withColumn("r", R.parse_variant("clean"))).select("line", "text")
    for k, change in enumerate((shown, render)):
        streams.run_available(S.stream_log_lines(spark, f"{tmp_path}/in", 1), f"{tmp_path}/o{k}", f"{tmp_path}/c{k}", change).awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/o{k}").collect()), key=repr) == sorted(map(tuple, change(batch).collect()), key=repr)
    first = S.stream_log_lines(spark, f"{tmp_path}/in").limit(3).writeStream.format("memory").queryName("first_lines").outputMode("append").trigger(availableNow=True).start()
    first.awaitTermination()
    assert spark.table("first_lines").count() == 3
    streams.route(S.stream_log_lines(spark, f"{tmp_path}/in"), f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/cp2").awaitTermination()
    good, bad = (spark.read.parquet(f"{tmp_path}/{x}").count() for x in ("good", "bad"))
    assert (good, bad) == (batch.filter("status = 'record'").count(), batch.filter(F.col("status").isin(*C.BAD)).count())


def test_order_of_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(str(i) for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = [int(r["line"]) for r in S.read_log_lines(spark, str(tmp_path)).orderBy(*S.ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == list(range(2000))


def test_empty_table(spark):
    seen = C.classify_lines(_lines(spark).limit(0))
    assert C.strict_prefix(seen, ["line_no"]).count() == 0 and C.parse_quality_report(seen, "line_no").count() == 0


def test_nulls_go_without_a_step_a_piece(spark):
    """Nulls are cut out of printed JSON by one expression, whatever stands in texts beside them; events with few row groups are dealt to more tasks."""
    from lograft import queries as Q

    texts = ['[null]', '[null,null,1,null]', '{"null":null,"a":"null","b":[",null",null]}', '{"a":null,"b":{"c":null}}', '["\\":null,",null,"x"]', '[[null],{},null]', '"null"', "null"]
    want = ['[]', '[1]', '{"a":"null","b":[",null"]}', '{"b":{}}', '["\\":null,","x"]', '[[],{}]', '"null"', "null"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    assert [r["t"] for r in df.select("i", R.without_nulls(F.col("t")).alias("t")).orderBy("i").collect()] == want
    plan = df.select(R.without_nulls(F.col("t")))._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "filter(" not in plan
    assert Q.nulls_at_any_depth(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > spark.read.parquet("/root/testdata/sf0.001/events.parquet").rdd.getNumPartitions()


def test_plain_text_prints_as_its_variant(spark):
    """Text read row by row prints as its variant does, odd text too; deep records no longer print a name at a time, nor make lines nobody reads."""
    import random

    from pyspark.sql import types as T

    from lograft import queries as Q

    odd = [
        '{"b":1,"a":2}', '{"a":1.50,"b":null}', '{"a":1e3}', '{"a":-0}', '{"a":123456789012345678901}', '{"a":[1,null,[null,[null]]]}', '"\\u001f\\ud83d\\ude00"', "null", " [ null , 1 ] ",
        '{"é":1,"z":null,"\U0001f600":2,"\uffee":3}', '{"a":"\\b\\f\\n\\r\\t\\"\\\\/"}', '{"a":"x\x7f\u2028"}', "[]", "{}", '{"":null,"A":{"":{}}}', '{"a":true,"b":false}', None, "17", '{"n":"null","m":[",null"]}', '"\\/"',
    ]
    rng = random.Random(5)

    def made(depth):
        kind = rng.randrange(7 if depth else 4)
        if kind < 4:
            return ["null", str(rng.randrange(-99, 10**rng.randrange(1, 19))), '"q\\"uo,null:te"', rng.choice(("true", "0.5", '"ü"', "-1"))][kind]
        inner = [made(depth - 1) for _ in range(rng.randrange(5))]
        return "[" + ", ".join(inner) + "]" if kind == 4 else "{" + ",".join(f'"k{n * 7 % 5}" :{x}' for n, x in enumerate(inner)) + "}"

    texts = odd + [made(5) for _ in range(400)] + ['[{"a":[null,' * 200 + "1" + ',null],"b":null}]' * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("t", R.compact_json_text("t").alias("new"), R.to_compact_json(F.parse_json("t"), T.VariantType()).alias("old")).collect()
    assert [r for r in got if r["new"] != r["old"]] == []
    assert sum(R._plain_without_nulls(t) is not None for t in texts) > 200
    for bad in ('{"a":1,"a":null}', "{null}", '[1,null,]', '{"a":NaN}', "{"):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame([(bad,)], "t string").select(R.compact_json_text("t")).collect()
    assert "date_format" not in Q.nulls_at_any_depth(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()

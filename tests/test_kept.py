"""Kept records: what later reads take, and what they get."""

from pyspark.sql import functions as F

from lograft.functions import records as R
from lograft.sources import kept as K

LINES = ['{"a":{"b":1,"c":"x"},"n":2}', '{"a":{"b":"text"},"n":null}', '{"odd":[1,{"z":null}]}', "[1,2]", "no record", "", '{"a":7}', '{"n":3.5}']


def test_later_reads_take_single_fields(spark, tmp_path):
    df = spark.createDataFrame([(i, f"s{i % 2}", x) for i, x in enumerate(LINES * 50)], "line_no long, source string, line string")
    K.keep_records(df, f"{tmp_path}/kept", by=["source"])
    kept = K.kept_records(spark, f"{tmp_path}/kept")
    assert kept.count() == 6 * 50 and set(kept.columns) == {"line_no", "v", "source"}
    fields = kept.select("line_no", K.kept_field("a.b").alias("b"), K.kept_field("n", "double").alias("n"))
    plan = fields._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("ReadSchema: ") :].split("\n")[0]
    assert "v:struct<0:" in scan and "variant" not in scan
    got = {r["line_no"]: (r["b"], r["n"]) for r in fields.filter("line_no < 8").collect()}
    assert got == {0: ("1", 2.0), 1: ("text", None), 2: (None, None), 3: (None, None), 6: (None, None), 7: (None, 3.5)}
    whole = {r["line_no"]: r["t"] for r in kept.filter("line_no < 8").select("line_no", F.to_json("v").alias("t")).collect()}
    direct = {i: r["t"] for i, r in enumerate(spark.createDataFrame([(x,) for x in LINES], "x string").select(F.to_json(F.try_parse_json("x")).alias("t")).collect())}
    assert whole == {i: direct[i] for i in whole}
    pointed = kept.filter("line_no = 2").select(F.to_json(R.json_pointer("v", "/odd/1/z"))).first()[0]
    assert pointed == "null"


def test_nothing_is_kept_of_nothing(spark, tmp_path):
    K.keep_records(spark.createDataFrame([], "line string"), f"{tmp_path}/kept")
    assert K.kept_records(spark, f"{tmp_path}/kept").count() == 0

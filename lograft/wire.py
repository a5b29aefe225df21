"""Log lines made of the ``events`` table, clean and dirty, and the same rules in SQL.

Every row of ``events`` becomes one JSON line whose field names vary as they do between services, or
one of six kinds of dirt. The SQL states the expected outcome from the typed columns; it parses no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograft.operators.cleaning import computed_once
from lograft.sources.lines import lines_from_table

#: The fields of the records below, as declared for the struct view.
_TEXT = T.StringType()
SCHEMA = T.StructType(
    [T.StructField(n, _TEXT) for n in ("timestamp", "level", "lvl", "severity", "message", "msg", "body")]
    + [
        T.StructField("fields", T.StructType().add("message", _TEXT)),
        T.StructField("data", T.StructType().add("user_id", T.LongType()).add("k", T.LongType()).add("tags", T.ArrayType(_TEXT)).add("error_code", _TEXT)),
    ]
)


def _record() -> list[Column]:
    i = F.col("event_id")
    kind = F.col("event_type")
    up = F.when(kind == "error", "ERROR").when(kind == "purchase", "INFO").when(kind == "signup", "DEBUG").when(kind == "click", "TRACE").otherwise("WARN")
    level = F.when(i % 2 == 1, F.lower(up)).otherwise(up)
    said = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(' said "'), kind, F.lit('"'))
    tags = F.array(F.lit("a"), F.when(i % 2 == 0, "b"), F.lit("c"))
    return [
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(i % 3 == 0, level).alias("level"),
        F.when(i % 3 == 1, level).alias("lvl"),
        F.when((i % 3 == 2) | (i % 6 == 0), level).alias("severity"),
        F.when(i % 4 == 0, said).alias("message"),
        F.when(i % 4 == 1, said).alias("msg"),
        F.when(i % 4 == 2, said).alias("body"),
        F.when(i % 4 == 3, F.struct(said.alias("message"))).alias("fields"),
        F.struct(
            F.col("user_id"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), tags.alias("tags"), F.when(kind == "error", "E1").alias("error_code")
        ).alias("data"),
    ]


def events(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """All events; ``spread`` as for ``written``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return e.repartition(tasks, "event_id", "ts") if spread else e


def written(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """All columns of every event, and ``js``, the record as it is written, before any dirt.

    With ``spread`` events are dealt to all cores first: a file of few row groups is read by few tasks,
    too few where an event of some bytes becomes kilobytes of text or much work.
    """
    e, record = events(spark, sf_dir, spread), _record()
    nulls = F.col("event_id") % 7 == 0
    return computed_once(e, js=F.when(nulls, lines_from_table(*record, nulls=True)).otherwise(lines_from_table(*record)))


def wire(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``line_no, source, line``; ``spread`` as for ``written``."""
    i = F.col("event_id")
    line = (
        F.when(i % 101 == 100, " \t ")
        .when(i % 97 == 96, F.concat(F.lit("plain text line "), i.cast("string")))
        .when(i % 89 == 88, F.substring("js", 1, 25))
        .when(i % 83 == 82, '"str"')
        .when(i % 79 == 78, F.concat(F.lit("{bad:1,"), F.substring("js", 2, 1_000_000)))
        .when(i % 5 == 0, F.concat(F.lit("\x1b[31m"), F.col("js"), F.lit("\x1b[0m")))
        .otherwise(F.col("js"))
    )
    lines = computed_once(written(spark, sf_dir, spread).select("event_id", "js"), line=line)
    return lines.select(i.alias("line_no"), F.lit("events").alias("source"), "line")


#: ``w``: every line with its status and the typed content of its record; ``e`` and ``s`` add the record as written and the line as sent; ``r``: records.
SQL = """
WITH t AS (
  SELECT event_id AS line_no, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'INFO' WHEN 'signup' THEN 'DEBUG' WHEN 'click' THEN 'TRACE' ELSE 'WARN' END AS up,
    'user ' || user_id || ' said "' || event_type || '"' AS said,
    CASE WHEN event_id % 101 = 100 THEN 'blank' WHEN event_id % 97 = 96 THEN 'non_json' WHEN event_id % 89 = 88 THEN 'truncated'
      WHEN event_id % 83 = 82 THEN 'non_json' WHEN event_id % 79 = 78 THEN 'malformed' ELSE 'record' END AS status
  FROM events),
u AS (
  SELECT *, CASE WHEN line_no % 2 = 1 THEN lower(up) ELSE up END AS lv,
    CASE line_no % 3 WHEN 0 THEN 'level' WHEN 1 THEN 'lvl' ELSE 'severity' END AS lv_key,
    CASE line_no % 4 WHEN 0 THEN 'message' WHEN 1 THEN 'msg' WHEN 2 THEN 'body' ELSE 'fields.message' END AS msg_key,
    CASE WHEN event_type = 'error' THEN 'E1' END AS code,
    replace(said, '"', '\\"') AS said_js
  FROM t),
w AS (
  SELECT *, '"tags":["a",' || CASE WHEN line_no % 2 = 0 THEN '"b",' ELSE '' END || '"c"]' AS tags_js,
    '"data":{"user_id":' || user_id || ',"k":' || k || ',"tags":["a",' || CASE WHEN line_no % 2 = 0 THEN '"b",' ELSE '' END || '"c"]'
      || CASE WHEN code IS NULL THEN '' ELSE ',"error_code":"' || code || '"' END || '}' AS data_js,
    '"' || lv_key || '":"' || lv || '"' || CASE WHEN line_no % 6 = 0 THEN ',"severity":"' || lv || '"' ELSE '' END AS lv_js,
    CASE WHEN msg_key = 'fields.message' THEN '"fields":{"message":"' || said_js || '"}' ELSE '"' || msg_key || '":"' || said_js || '"' END AS msg_js
  FROM u),
x AS (SELECT *, '"user_id":' || user_id || ',"k":' || k || ',"tags":["a",' || CASE WHEN line_no % 2 = 0 THEN '"b"' ELSE 'null' END || ',"c"]' AS inner_js FROM w),
e AS (SELECT *, CASE WHEN line_no % 7 = 0 THEN
      '{"timestamp":"' || ts || '","level":' || CASE WHEN line_no % 3 = 0 THEN '"' || lv || '"' ELSE 'null' END
      || ',"lvl":' || CASE WHEN line_no % 3 = 1 THEN '"' || lv || '"' ELSE 'null' END
      || ',"severity":' || CASE WHEN line_no % 3 = 2 OR line_no % 6 = 0 THEN '"' || lv || '"' ELSE 'null' END
      || ',"message":' || CASE WHEN line_no % 4 = 0 THEN '"' || said_js || '"' ELSE 'null' END
      || ',"msg":' || CASE WHEN line_no % 4 = 1 THEN '"' || said_js || '"' ELSE 'null' END
      || ',"body":' || CASE WHEN line_no % 4 = 2 THEN '"' || said_js || '"' ELSE 'null' END
      || ',"fields":' || CASE WHEN line_no % 4 = 3 THEN '{"message":"' || said_js || '"}' ELSE 'null' END
      || ',"data":{' || inner_js || ',"error_code":' || CASE WHEN code IS NULL THEN 'null' ELSE '"' || code || '"' END || '}}'
    ELSE '{"timestamp":"' || ts || '",' || lv_js || ',' || msg_js || ',"data":{' || inner_js || CASE WHEN code IS NULL THEN '' ELSE ',"error_code":"' || code || '"' END || '}}' END AS raw
  FROM x),
s AS (SELECT *, CASE WHEN status = 'blank' THEN ' ' || chr(9) || ' ' WHEN line_no % 97 = 96 THEN 'plain text line ' || line_no WHEN status = 'truncated' THEN raw[1:25]
      WHEN status = 'non_json' THEN '"str"' WHEN status = 'malformed' THEN '{bad:1,' || raw[2:] WHEN line_no % 5 = 0 THEN chr(27) || '[31m' || raw || chr(27) || '[0m' ELSE raw END AS sent
  FROM e),
r AS (SELECT *, '{"timestamp":"' || ts || '",' || lv_js || ',' || msg_js || ',' || data_js || '}' AS js,
    '{' || CASE WHEN line_no % 6 = 0 THEN '"severity":"' || lv || '",' ELSE '' END
      || CASE WHEN msg_key = 'fields.message' THEN '"fields":{},' ELSE '' END || data_js || '}' AS rest_js
  FROM w WHERE status = 'record')
"""

"""A query for every operator, over log lines made of the whole ``events`` table, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lograft import wire as W
from lograft.functions import records as R
from lograft.operators import cleaning as C
from lograft.operators import drift as D
from lograft.operators import faults as E
from lograft.operators import normalize as N
from lograft.plans import layout as L
from lograft.sources import kept as K
from lograft.sources import lines as S
from lograft.sources import ordered as O
from lograft.sources.scratch import new_path
from lograft.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name, with the SQL that follows the rules of ``wire``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = W.SQL + sql
        return f

    return add


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify_lines(W.wire(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``line_no, r`` of the records: the struct is read from the variant that the test for a record has parsed."""
    return _variants(spark, sf_dir, spread).select("line_no", R.struct_of("v", W.SCHEMA).alias("r"))


def _variants(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """``line_no, v`` of the records: the variant that the test for a record has parsed."""
    return C.classify_lines(W.wire(spark, sf_dir, spread), parsed="v").filter("status = 'record'").select("line_no", "v")


def _texts(name: str, sql: str, pieces: list, layouts: dict | None = None, **how: bool) -> None:
    """Register a layout: its text per record."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return L.render(_records(spark, sf_dir), pieces, layouts=layouts, **how).select("line_no", "text")

    run.__name__ = name
    _query(f"SELECT line_no, {sql} AS text FROM r")(run)


def _columns(name: str, sql: str, **columns: Callable[[], Column]) -> None:
    """Register columns of the struct view ``r``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _records(spark, sf_dir).select("line_no", *(c().alias(n) for n, c in columns.items()))

    run.__name__ = name
    _query(f"SELECT line_no, {sql} FROM r")(run)


# -- sources and sinks ---------------------------------------------------------------------------


@_query("SELECT status, count(*) AS lines FROM w GROUP BY status")
def read_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "lines")
    S.write_lines(W.wire(spark, sf_dir), path, "line")
    return C.classify_lines(S.read_log_lines(spark, path)).groupBy("status").agg(F.count("*").alias("lines"))


@_query("SELECT status, count(*) AS lines FROM w GROUP BY status")
def stream_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = new_path(spark, "lines"), new_path(spark, "streamed")
    S.write_lines(W.wire(spark, sf_dir), path, "line")
    streams.run_available(S.stream_log_lines(spark, path), out, new_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).groupBy("status").agg(F.count("*").alias("lines"))


@_query("SELECT line_no, raw AS line FROM e")
def lines_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every event, with explicit nulls where it has them."""
    return W.written(spark, sf_dir).select(F.col("event_id").alias("line_no"), F.col("js").alias("line"))


@_query("SELECT js AS text, count(*) AS n FROM r GROUP BY js")
def write_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "written")
    S.write_lines(L.render(_records(spark, sf_dir), [L.whole()]), path)
    return S.read_log_lines(spark, path).groupBy(F.col("line").alias("text")).agg(F.count("*").alias("n"))


@_query("SELECT line_no, status FROM w WHERE status NOT IN ('record', 'blank')")
def write_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "quarantine")
    S.write_quarantine(_classified(spark, sf_dir), path)
    return spark.read.parquet(path).select("line_no", F.col("status").cast("string").alias("status"))


def _filed(spark: SparkSession, sf_dir: str, files: int = 10) -> str:
    """A folder with the lines of the table in order, in files whose names are in order too."""
    path = new_path(spark, "filed")
    O.write_in_order(O.in_order(W.wire(spark, sf_dir), "line_no", partitions=files), path, "line")
    return path


@_query("SELECT row_number() OVER (ORDER BY line_no) AS line_no, sent AS line FROM s")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true number of every line, through all files."""
    return O.read_numbered_lines(spark, _filed(spark, sf_dir), across=True).select("line_no", "line")


@_query("""SELECT row_number() OVER (ORDER BY s.line_no) AS line_no, CASE WHEN s.status = 'record' THEN r.ts || ' ' || r.lv || ' ' || r.said || ' ' || r.rest_js ELSE sent END AS text
    FROM s LEFT JOIN r ON s.line_no = r.line_no WHERE s.status <> 'blank'""")
def ordered_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output in the order of the input: records rendered, bad lines untouched; read back with its line numbers."""
    dealt = O.in_order(O.read_numbered_lines(spark, _filed(spark, sf_dir)), *O.NUMBERED, partitions=10)
    seen = C.classify_lines(dealt, parsed="v").withColumn("r", R.struct_of("v", W.SCHEMA))
    path = new_path(spark, "echoed")
    O.write_in_order(O.echoed(L.default_render(seen)), path)
    return O.read_numbered_lines(spark, path, across=True).select("line_no", F.col("line").alias("text"))


@_query("SELECT status, sent AS line FROM s ORDER BY line_no LIMIT 700")
def take_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of many files; the files behind them stay unread."""
    return C.classify_lines(O.take_first_lines(spark, _filed(spark, sf_dir), 700)).select("status", "line")


_PREFIX = "SELECT sent AS line FROM s WHERE status = 'record' AND line_no < (SELECT min(line_no) FROM w WHERE status NOT IN ('record', 'blank'))"


@_query(_PREFIX)
def strict_prefix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records before the first bad line of many files; the files behind it stay unread."""
    return O.strict_prefix_lines(spark, _filed(spark, sf_dir)).select("line")


@_query(_PREFIX)
def strict_prefix_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stream, by the stop that the folder's state holds."""
    out = new_path(spark, "prefix")
    streams.strict_prefix(S.stream_log_lines(spark, _filed(spark, sf_dir)), out, new_path(spark, "stops"), new_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("line")


# -- cleaning and classification -----------------------------------------------------------------


@_query("SELECT line_no FROM w WHERE status <> 'blank'")
def drop_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.drop_blank(W.wire(spark, sf_dir)).select("line_no")


@_query("""SELECT line_no, CASE status WHEN 'record' THEN raw WHEN 'blank' THEN ' ' || chr(9) || ' ' WHEN 'truncated' THEN raw[1:25]
    WHEN 'malformed' THEN '{bad:1,' || raw[2:] ELSE CASE WHEN line_no % 97 = 96 THEN 'plain text line ' || line_no ELSE '"str"' END END AS text FROM e""")
def strip_ansi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.wire(spark, sf_dir).select("line_no", C.strip_ansi("line").alias("text"))


@_query("SELECT line_no, raw AS text FROM e")
def strip_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record between terminal sequences of all kinds, 7-bit and 8-bit, with and without an end."""
    around = [
        ("\x1b[1;31m", "\x1b[0m"), ("\x1b(B", "\x1bc"), ("\x1bP1$r0m\x1b\\", ""), ("\u009b31m", "\u009b0m"), ("\x1b]0;title\x07", "\x1b]0;"),
        ("\x1b]8;;http://x\x1b\\", "\x1b]8;;\x1b\\"), ("\x1b7", "\x1b8\x1b="), ("\x1b_app\u009c", "\x1b[3"),
    ]
    i = F.col("event_id")
    lines = W.written(spark, sf_dir)
    put = lambda k: F.concat(F.lit(around[k][0]), F.col("js"), F.lit(around[k][1]))
    line = F.coalesce(*(F.when(i % len(around) == k, put(k)) for k in range(len(around))))
    return lines.select(i.alias("line_no"), C.strip_ansi(line).alias("text"))


@_query("SELECT line_no, status FROM w")
def classify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).select("line_no", "status")


@_query("SELECT line_no, ts, user_id, lv AS level FROM r")
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _variants(spark, sf_dir)
    level = F.coalesce(*(R.variant_field("v", n) for n in N.LEVEL))
    return v.select("line_no", R.variant_field("v", "timestamp").alias("ts"), R.variant_field("v", "data.user_id", "bigint").alias("user_id"), level.alias("level"))


@_query("""SELECT line_no, ts, user_id, CASE WHEN line_no % 2 = 0 THEN lv END AS even, 1::BIGINT AS void FROM r""")
def discover_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records read by a schema found in them, with names that hold words for types, quotes and blanks."""
    v = F.col("v")
    odd = {"AVOIDED": F.parse_json(F.lit("1")), "OBJECT<a `b`": F.when(F.col("line_no") % 2 == 0, R.variant_field("v", "timestamp", "variant"))}
    kept = _variants(spark, sf_dir).select("line_no", F.to_json(_with(v, odd)).alias("clean"))
    even = F.when(F.col("line_no") % 2 == 0, F.coalesce(*(R.variant_field("w", n) for n in N.LEVEL)))
    schema = R.discover_schema(kept)
    got = kept.select("line_no", R.parse_struct("clean", schema).alias("r"), F.parse_json("clean").alias("w"))
    return got.filter((F.col("line_no") % 2 == 1) | F.col("r").getField("OBJECT<a `b`").isNotNull()).select(
        "line_no", F.col("r.timestamp").alias("ts"), F.col("r.data.user_id").alias("user_id"), even.alias("even"), F.col("r.AVOIDED").alias("void")
    )


def _with(v: Column, more: dict[str, Column]) -> Column:
    """A variant object with further fields."""
    members = F.try_variant_get(v, "$", "map<string,variant>")
    added = F.create_map(*(x for n, c in more.items() for x in (F.lit(n), F.coalesce(c, F.parse_json(F.lit("null"))))))
    return F.to_variant_object(F.map_concat(members, added))


@_query("""SELECT 'events' AS source, status, count(*) AS lines, min(line_no) AS first_line, count(*) FILTER (line_no % 13 = 0) AS invalid_utf8,
    CASE WHEN status NOT IN ('record', 'blank') THEN status END AS error_class FROM w GROUP BY status""")
def parse_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth line ends in a byte that is no UTF-8, every eleventh in the sign that stands for such bytes."""
    i = F.col("line_no")
    seen = _classified(spark, sf_dir)
    line = F.when(i % 13 == 0, F.concat(F.col("line").cast("binary"), F.unhex(F.lit("FF"))).cast("string")).when(i % 11 == 0, F.concat("line", F.lit("\ufffd"))).otherwise(F.col("line"))
    return C.parse_quality_report(seen.withColumn("line", line), "line_no").drop("snippet")


_SHAPES = [  # a record damaged, and where and why it is no record, from its length
    ("substr(js, 1, length(js) - 1)", "length(js) - 1", E.ENDS_EARLY), ("'{\"timestamp\" ' || substr(js, 14)", "13", E.NO_COLON), ("'{,' || substr(js, 2)", "1", E.NO_NAME),
    ("substr(js, 1, length(js) - 1) || ',}'", "length(js)", E.EARLY_BRACE), ("'[' || js || ',]'", "length(js) + 2", E.EARLY_BRACKET), ("'[' || js || '}'", "length(js) + 1", E.NO_COMMA_ARRAY),
    ("substr(js, 1, length(js) - 1) || ',\"x\":tru}'", "length(js) + 4", E.NOT_A_VALUE), ("substr(js, 1, length(js) - 1) || ',\"x\":\"a}'", "length(js) + 4", E.OPEN_TEXT),
    ("substr(js, 1, length(js) - 1) || ',\"x\":\"' || chr(92) || 'q\"}'", "length(js) + 4", E.ODD_TEXT), ("substr(js, 1, length(js) - 1) || ' 1}'", "length(js)", E.NO_COMMA_OBJECT),
    ("substr(js, 1, length(js) - 1) || ',\"x\":}'", "length(js) + 4", E.EARLY_BRACE), ("'[' || js || ',,1]'", "length(js) + 2", E.NO_VALUE),
    ("substr(js, 1, length(js) - 1) || ',\"timestamp\":1}'", "NULL", E.OTHER), ("'x' || js", "0", E.NO_RECORD), ("js", "NULL", None),
]


def _case(values: list[str]) -> str:
    return f"CASE line_no % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@_query("SELECT line_no, " + _case([a for _, a, _ in _SHAPES]) + "::INT AS error_at, " + _case([f"'{r}'" if r else "NULL" for _, _, r in _SHAPES]) + " AS error_reason FROM r")
def explain_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record, damaged in one of fourteen ways or not at all, with the place and the reason of its fault."""
    js = R.to_compact_json("r", W.SCHEMA)
    lines = C.computed_once(_records(spark, sf_dir, spread=True).select("line_no", js.alias("js")), line=F.expr(_case([d for d, _, _ in _SHAPES])))
    return E.explain_bad(C.classify_lines(lines)).select("line_no", "error_at", "error_reason")


@_query(f"""SELECT 'events' AS source, count(*) AS lines, min(line_no) AS first_line,
    CASE status WHEN 'non_json' THEN '{E.NO_RECORD}' WHEN 'truncated' THEN '{E.OPEN_TEXT}' ELSE '{E.NO_NAME}' END AS error_reason,
    CASE status WHEN 'non_json' THEN 0 WHEN 'truncated' THEN 13 ELSE 1 END::INT AS first_at FROM w WHERE status NOT IN ('record', 'blank') GROUP BY status""")
def fault_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.fault_report(_classified(spark, sf_dir), "line_no")


@_query("SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in C.STATUSES) + ", count(*) AS lines, 0::BIGINT AS invalid_utf8 FROM w")
def observed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts observed while a stream writes its batches, added up over them."""
    path, to = _filed(spark, sf_dir), [new_path(spark, n) for n in ("records", "bad", "offsets", "report")]
    streams.route(S.stream_log_lines(spark, path, 3), *to[:3], report=to[3]).awaitTermination()
    names = [*C.STATUSES, "lines", "invalid_utf8"]
    return spark.read.parquet(to[3]).agg(*(F.sum(n).alias(n) for n in names))


@_query("SELECT line_no, status = 'record' AS valid FROM w WHERE status <> 'blank'")
def split_valid_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = C.split_valid_invalid(_classified(spark, sf_dir))
    return good.select("line_no", F.lit(True).alias("valid")).unionByName(bad.select("line_no", F.lit(False).alias("valid")))


@_query("""SELECT line_no, EXISTS (SELECT 1 FROM w WHERE status NOT IN ('record', 'blank')) AS failed,
    coalesce((SELECT min_by(status, line_no) FROM w WHERE status NOT IN ('record', 'blank')), '') AS said FROM r""")
def strict_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records, as strict reading passes them without the bad lines; whether it fails on the whole table, and what it says up to the first bad line."""
    seen = _classified(spark, sf_dir)

    def told(lines: DataFrame) -> str:
        """The kind of bad line at which strict reading fails, empty where it passes."""
        try:
            C.strict_fail(lines).write.format("noop").mode("overwrite").save()
        except Exception as e:
            said = next((x for x in C.BAD if f"{x} line: " in str(e)), None)
            if said is None:
                raise
            return said
        return ""

    failed = told(seen) != ""
    first = seen.filter(F.col("status").isin(*C.BAD)).agg(F.min("line_no").alias("first")).first()["first"]
    said = told(seen.filter(F.col("line_no") <= first)) if first is not None else ""
    sound = C.strict_fail(seen.filter(~F.col("status").isin(*C.BAD)))
    return sound.select("line_no", F.lit(failed).alias("failed"), F.lit(said).alias("said"))


@_query("SELECT line_no FROM r WHERE line_no < (SELECT min(line_no) FROM w WHERE status NOT IN ('record', 'blank'))")
def strict_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.strict_prefix(_classified(spark, sf_dir), ["line_no"]).select("line_no")


@_query("SELECT line_no, status FROM w ORDER BY line_no LIMIT 500")
def take_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify_lines(C.take_lines(W.wire(spark, sf_dir), 500, ["line_no"])).select("line_no", "status")


# -- fields --------------------------------------------------------------------------------------

_r = "r"
_columns("field", "ts AS value, CASE WHEN line_no % 3 = 1 THEN lv END AS lvl", value=lambda: R.field(_r, W.SCHEMA, "timestamp"), lvl=lambda: R.field(_r, W.SCHEMA, "lvl"))
_columns(
    "field_path", "user_id, code, CASE WHEN msg_key = 'fields.message' THEN said END AS said",
    user_id=lambda: R.field(_r, W.SCHEMA, "data.user_id"), code=lambda: R.field(_r, W.SCHEMA, "data.error_code"), said=lambda: R.field(_r, W.SCHEMA, "fields.message"),
)
_columns(
    "field_index", "'a' AS t0, CASE WHEN line_no % 2 = 0 THEN 'b' END AS t1, NULL::VARCHAR AS t9",
    t0=lambda: R.field(_r, W.SCHEMA, "data.tags[0]"), t1=lambda: R.field(_r, W.SCHEMA, "data.tags[1]"), t9=lambda: R.field(_r, W.SCHEMA, "data.tags[9]"),
)
_columns("first_of", "lv AS level, said AS message", level=lambda: R.first_of(_r, W.SCHEMA, *N.LEVEL), message=lambda: R.first_of(_r, W.SCHEMA, *N.MESSAGE))
_columns("which_of", "lv_key AS level, msg_key AS message", level=lambda: R.which_of(_r, W.SCHEMA, *N.LEVEL), message=lambda: R.which_of(_r, W.SCHEMA, *N.MESSAGE))
_texts("whole", "js", [L.whole()])
_texts("rest", "ts || ' ' || lv || ' ' || said || ' ' || rest_js", [L.arg("timestamp"), " ", L.arg(*N.LEVEL), " ", L.arg(*N.MESSAGE), " ", L.rest()])
_columns(
    "rest_nonempty", "true AS all_fields, line_no % 6 = 0 AS other_level",
    all_fields=lambda: R.has_content(F.col(_r), W.SCHEMA, {("timestamp",): F.lit(True)}),
    other_level=lambda: R.has_content(
        F.col(_r), W.SCHEMA,
        {(n,): F.lit(True) for n in W.SCHEMA.names if n != "severity"} | {("severity",): F.col("r.level").isNull()},
    ),
)
_columns("drop_field", "'{\"timestamp\":\"' || ts || '\",' || lv_js || ',' || msg_js || ',\"data\":{\"k\":' || k || ',\"tags\":[' || CASE WHEN line_no % 2 = 0 THEN '\"b\",' ELSE '' END || '\"c\"]' || CASE WHEN code IS NULL THEN '' ELSE ',\"error_code\":\"E1\"' END || '}}' AS text", text=lambda: R.to_compact_json(R.drop_field(_r, W.SCHEMA, "data.user_id", "data.tags[0]"), W.SCHEMA))
_columns("set_field", "'fixed' AS level, user_id + 1 AS user_id, line_no::VARCHAR AS parsed", level=lambda: R.set_field(_r, "level", F.lit("fixed"))["level"], user_id=lambda: R.set_field(_r, "data.user_id", F.col("r.data.user_id") + 1)["data"]["user_id"], parsed=lambda: R.set_parsed(_r, "fields", F.concat(F.lit('{"message":"'), F.col("line_no"), F.lit('"}')), "message string")["fields"]["message"])
_columns("update_at", "CASE WHEN line_no % 2 = 0 THEN 'B' END AS slot, upper(said) AS said", slot=lambda: F.get(R.update_at(_r, W.SCHEMA, "data.tags[1]", F.upper)["data"]["tags"], 1), said=lambda: F.upper(R.first_of(R.update_at(_r, W.SCHEMA, "fields.message", F.upper), W.SCHEMA, *N.MESSAGE)))


@_query("SELECT line_no, ts AS timestamp, lv AS level, said AS message, rest_js AS data FROM r")
def normalize_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.normalize_log(_records(spark, sf_dir)).select("line_no", "timestamp", "level", "message", "data")


@_query("SELECT line_no, up AS severity, CASE up WHEN 'TRACE' THEN 0 WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2 WHEN 'WARN' THEN 3 ELSE 4 END AS rank FROM r")
def severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = N.normalize_log(_records(spark, sf_dir))
    return seen.select("line_no", N.severity("level").alias("severity"), N.severity_rank("level").alias("rank"))


@_query("""SELECT line_no, user_id, CASE WHEN line_no % 2 = 0 THEN 'b' END AS slot, code,
    CASE WHEN code IS NOT NULL THEN 'string' WHEN line_no % 7 = 0 THEN 'null' ELSE 'missing' END AS code_kind FROM r""")
def json_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _variants(spark, sf_dir)
    code = R.json_pointer("v", "/data/error_code")
    kind = F.when(code.isNull(), "missing").otherwise(R.json_kind(code))
    text = lambda p, kind="string": F.try_variant_get(R.json_pointer("v", p), "$", kind)
    return v.select(
        "line_no", text("/data/user_id", "bigint").alias("user_id"), text("/data/tags/1").alias("slot"),
        F.when(~F.is_variant_null(code), F.try_variant_get(code, "$", "string")).alias("code"), kind.alias("code_kind"),
    )


@_query("""SELECT line_no, CASE line_no % 5 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN CASE WHEN line_no % 2 = 0 THEN '"b"' ELSE 'null' END
    WHEN 2 THEN CASE WHEN msg_key = 'fields.message' THEN '"' || said_js || '"' END WHEN 3 THEN k::VARCHAR END AS value FROM r""")
def json_pointer_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointer of its own for each record."""
    at = F.element_at(F.array(*map(F.lit, ("/data/user_id", "/data/tags/1", "/fields/message", "/data/k", "/nothing/0"))), (F.col("line_no") % 5 + 1).cast("int"))
    return _variants(spark, sf_dir).select("line_no", F.to_json(R.json_pointer_at("v", at)).alias("value"))


_MEMBERS = """SELECT line_no, 'timestamp' AS key, '"' || ts || '"' AS value FROM r UNION ALL SELECT line_no, 'data', NULL FROM r
    UNION ALL SELECT line_no, key, CASE WHEN key = lv_key OR key = 'severity' AND line_no % 6 = 0 THEN '"' || lv || '"' ELSE 'null' END FROM (SELECT *, unnest(['level', 'lvl', 'severity']) AS key FROM r)
      WHERE line_no % 7 = 0 OR key = lv_key OR key = 'severity' AND line_no % 6 = 0
    UNION ALL SELECT line_no, key, CASE WHEN key = msg_key THEN '"' || said_js || '"' ELSE 'null' END FROM (SELECT *, unnest(['message', 'msg', 'body']) AS key FROM r) WHERE line_no % 7 = 0 OR key = msg_key
    UNION ALL SELECT line_no, 'fields', CASE WHEN msg_key <> 'fields.message' THEN 'null' END FROM r WHERE line_no % 7 = 0 OR msg_key = 'fields.message'"""


@_query(f"SELECT line_no, key, value, (row_number() OVER (PARTITION BY line_no ORDER BY key) - 1)::INT AS pos FROM ({_MEMBERS})")
def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, places and scalar values of the members of each record."""
    scalar = F.when(~R.json_kind("value").isin("object", "array"), F.to_json("value"))
    return R.entries(_variants(spark, sf_dir), "v").select("line_no", "pos", "key", scalar.alias("value"))


@_query("SELECT line_no, 'object' AS whole, 'array' AS tags, 'string' AS ts, 'value' AS user_id, 'null' AS none FROM r")
def json_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {"whole": "", "tags": "/data/tags", "ts": "/timestamp", "user_id": "/data/user_id", "none": "/nothing"}
    return _variants(spark, sf_dir).select("line_no", *(R.json_kind(R.json_pointer("v", p)).alias(n) for n, p in at.items()))


@_query("SELECT line_no, ts, user_id, code FROM r")
def kept_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fields of records that were parsed once and kept; no other field is read."""
    path = new_path(spark, "kept")
    K.keep_records(W.wire(spark, sf_dir), path)
    at = {"ts": ("timestamp",), "user_id": ("data.user_id", "bigint"), "code": ("data.error_code",)}
    return K.kept_records(spark, path).select("line_no", *(K.kept_field(*p).alias(n) for n, p in at.items()))


# -- tests ---------------------------------------------------------------------------------------


def _kept(name: str, sql: str, test: Callable[[], Column]) -> None:
    """Register a row filter on the struct view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _records(spark, sf_dir).filter(test()).select("line_no")

    run.__name__ = name
    _query(f"SELECT line_no FROM r WHERE {sql}")(run)


_kept("has_key", "line_no % 3 = 1 OR msg_key = 'fields.message'", lambda: R.has_key(_r, W.SCHEMA, "lvl", "fields.message"))
_kept("truthy", "CASE WHEN code IS NOT NULL THEN true ELSE k <> 0 END", lambda: R.truthy(_r, W.SCHEMA, "data.error_code", "data.k"))
_kept("any_truthy", "code IS NOT NULL OR k <> 0 OR line_no % 3 = 1", lambda: R.any_truthy(_r, W.SCHEMA, "data.error_code", "data.k", "lvl"))
_kept("is_empty_json", "msg_key <> 'fields.message'", lambda: R.is_empty_json(F.col("r.fields"), W.SCHEMA["fields"].dataType))


@_query("SELECT line_no, k <> 0 AS k, true AS tags, true AS data, line_no % 3 = 1 AS lvl FROM r")
def truthy_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {"k": "data.k", "tags": "data.tags", "data": "data", "lvl": "lvl"}
    v = _variants(spark, sf_dir)
    return v.select("line_no", *(R.truthy_variant(R.variant_field("v", p, "variant")).alias(n) for n, p in at.items()))


_texts("has_key_whole", "'yes'", [L.when_key(L.WHOLE, "yes").else_("no")])
_texts("truthy_whole", "'yes'", [L.when_if(L.WHOLE, "yes").else_("no")])
_texts("has_key_rest", "ts || 'yes'", [L.arg("timestamp"), L.when_key(L.REST, "yes").else_("no")])
_texts("truthy_rest", "ts || ' yes'", [L.arg("timestamp"), L.when_if(L.REST, " yes").else_(" no")])

# -- branches ------------------------------------------------------------------------------------

_texts("when_key_else", "CASE WHEN lv_key = 'lvl' THEN 'l=' || lv WHEN lv_key = 'level' THEN 'L=' || lv ELSE '-' END", [L.when_key("lvl", "l=", L.arg("lvl")).else_key("level", "L=", L.arg("level")).else_("-")])
_texts("when_if_else", "CASE WHEN code IS NOT NULL THEN 'E' WHEN k <> 0 THEN 'k=' || k ELSE 'none' END", [L.when_if("data.error_code", "E").else_if("data.k", "k=", L.arg("data.k")).else_("none")])
_texts("nested_conditionals", "CASE WHEN code IS NOT NULL THEN 'E' || CASE WHEN lv_key = 'lvl' THEN '1' ELSE '0' END ELSE '-' END || '.'", [L.when_key("data.error_code", "E", L.when_key("lvl", "1").else_("0")).else_("-"), "."])
_texts("mixed_chains", "CASE WHEN code IS NOT NULL THEN 'a' WHEN lv_key = 'lvl' THEN 'b' ELSE 'c' END", [L.when_if("data.error_code", "a").else_key("lvl", "b").else_("c")])
_texts("no_branch_taken", "CASE WHEN code IS NOT NULL THEN 'E' ELSE '' END", [L.when_key("data.error_code", "E")])
_texts("layout_switch", "said || ' ' || ts", [L.arg(*N.MESSAGE), *L.layout_switch(True, [" "], ["\n"]), L.arg("timestamp")])

# -- rendering -----------------------------------------------------------------------------------

_texts("render", "ts || ' [' || lv || '] ' || said", [L.arg("timestamp"), " [", L.arg(*N.LEVEL), "] ", L.arg(*N.MESSAGE)])
_texts("missing_is_empty", "'<' || coalesce(code, '') || '|  >'", ["<", L.arg("data.error_code"), "|", L.arg("nothing", indent=2), ">"])
_texts("scalar_text", "user_id || '/' || lv", [L.arg("data.user_id"), "/", L.arg(*N.LEVEL)])
_texts("to_compact_json", "'{\"data\":' || substr(data_js, 8) || '}'", ['{"data":', L.arg("data", compact=True), "}"], compact=False)
_texts("arg_compact", "'[\"a\",' || CASE WHEN line_no % 2 = 0 THEN '\"b\",' ELSE '' END || '\"c\"]'", [L.arg("data.tags", compact=True)], compact=False)
_texts("escaped_literals", "chr(10) || chr(13) || chr(9) || '''\"{}' || chr(92)", ["\n\r\t'\"{}\\"])
_texts("splice_fields", "lv || ' ' || lv || ' ' || said", [L.ref("none", "level"), " ", L.ref("level"), " ", L.ref("message")], {"none": [], "level": [L.arg(*N.LEVEL)], "message": [L.arg(*N.MESSAGE)]})
_texts("indent_by", "'  ' || lv", [L.arg(*N.LEVEL, indent=2)])


@_query("""SELECT line_no, CAST(user_id AS BIGINT) AS user_id, data_js AS text, true AS lines FROM r""")
def to_pretty_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pretty text has more than one line and reads back as what it shows."""
    out = L.render(_records(spark, sf_dir), [L.arg("data", compact=False)])
    back = R.parse_struct("text", W.SCHEMA["data"].dataType)
    return out.select(
        "line_no", back["user_id"].alias("user_id"),
        F.concat(F.lit('"data":'), R.to_compact_json(back, W.SCHEMA["data"].dataType)).alias("text"), F.contains("text", F.lit("\n")).alias("lines"),
    )


@_query("SELECT line_no, lv || ' Message: ' || said || ' {\"timestamp\":\"' || ts || '\",' || substr(rest_js, 2) AS text FROM r")
def named_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default layout without a time and with its message text replaced."""
    own = {"time": [], "message": ["Message: ", L.arg(*N.MESSAGE)]}
    return L.default_render(_records(spark, sf_dir), layouts=own).select("line_no", "text")


@_query("SELECT line_no, ts || ' ' || lv || ' ' || said || ' ' || rest_js AS text FROM r")
def default_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.default_render(_records(spark, sf_dir)).select("line_no", "text")


@_query("""SELECT line_no, ts || ' {' || CASE WHEN msg_key = 'body' THEN '"body":"' || said_js || '",' ELSE '' END
    || '"data":{' || CASE WHEN code IS NULL THEN '' ELSE '"error_code":"' || code || '",' END || '"k":' || k || ',' || tags_js || ',"user_id":' || user_id || '}'
    || CASE WHEN msg_key = 'fields.message' THEN ',"fields":{"message":"' || said_js || '"}' ELSE '' END
    || CASE WHEN lv_key IN ('level', 'lvl') THEN ',"' || lv_key || '":"' || lv || '"' ELSE '' END
    || CASE WHEN msg_key IN ('message', 'msg') THEN ',"' || msg_key || '":"' || said_js || '"' ELSE '' END
    || CASE WHEN lv_key = 'severity' OR line_no % 6 = 0 THEN ',"severity":"' || lv || '"' ELSE '' END || '}' AS text FROM r""")
def rest_of_any_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest of records without a schema, by name; one parse each."""
    return L.render(_variants(spark, sf_dir), [L.arg("timestamp"), " ", L.rest()], "v").select("line_no", "text")


@_query("SELECT line_no, lpad(lv, 5, ' ') AS level FROM r")
def level_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.normalize_log(_records(spark, sf_dir)).select("line_no", N.pad_level("level").alias("level"))


@_query("""SELECT line_no, repeat('{"a":[{"b":', (line_no % 300)::INT) || '{"k":' || k || ',"s":"x' || chr(92) || '":null,[null]:null","u":' || user_id || ',"z":[{}]}' || repeat('}]}', (line_no % 300)::INT) AS text FROM w""")
def nulls_at_any_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records up to 600 levels deep with nulls on each, printed without them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))  # ten thousand deep records must not meet in one Python worker
    core = F.to_json(F.struct(F.expr("cast(get_json_object(props, '$.k') as bigint)").alias("k"), F.lit(None).cast("string").alias("n"), F.lit('x":null,[null]:null').alias("s"), F.col("user_id").alias("u")), {"ignoreNullFields": "false"})
    deep = (F.col("event_id") % 300).cast("int")
    text = F.concat(F.repeat(F.lit('{"a":[null,{"n":null,"b":'), deep), F.regexp_replace(core, "}$", ',"z":[null,{"y":null},null]}'), F.repeat(F.lit('},null],"c":null}'), deep))
    lines = C.computed_once(W.events(spark, sf_dir, spread=True).select("event_id", "user_id", "props"), text=text)
    return lines.select(F.col("event_id").alias("line_no"), R.compact_json_text("text").alias("text"))


_PATHS = """SELECT line_no, unnest(['$', '$.timestamp', '$.data', '$.data.user_id', '$.data.k', '$.data.tags', '$.data.tags[]']) AS path,
      unnest(['object', 'string', 'object', 'bigint', 'bigint', 'array', 'string']) AS kind FROM r
    UNION ALL SELECT line_no, '$.data.error_code', CASE WHEN code IS NULL THEN 'void' ELSE 'string' END FROM r WHERE code IS NOT NULL OR line_no % 7 = 0
    UNION ALL SELECT line_no, '$.fields.message', 'string' FROM r WHERE msg_key = 'fields.message'
    UNION ALL SELECT line_no, '$.' || key, CASE WHEN value IS NULL THEN 'object' WHEN value = 'null' THEN 'void' ELSE 'string' END FROM (""" + _MEMBERS + """) WHERE key NOT IN ('timestamp', 'data')"""


@_query(f"SELECT path, kind, count(*) AS records, min(line_no) AS first_line, max(line_no) AS last_line FROM ({_PATHS}) GROUP BY path, kind")
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of all records, added up from those of two halves."""
    seen = _variants(spark, sf_dir)
    return D.merged(D.drift_state(seen.filter("line_no % 2 = 0")).unionByName(D.drift_state(seen.filter("line_no % 2 = 1"))))

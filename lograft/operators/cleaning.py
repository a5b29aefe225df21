"""Cleaning lines, telling records from other lines, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ESC = "\x1b"
#: Terminal sequences, as 7-bit and 8-bit forms: controls (CSI), commands to the system (OSC), strings (DCS, SOS, PM, APC),
#: and all other escapes, with or without intermediate signs. One that does not end takes the rest of the line.
_ANSI = (
    r"(?:\x1b\[|\u009b)[0-?]*+[ -/]*+(?:[@-~]|$)|(?:\x1b\]|\u009d)[^\x07\x1b\u009c]*+(?:\x07|\x1b\\|\u009c|$)"
    r"|(?:\x1b[PX^_]|[\u0090\u0098\u009e\u009f])[^\x1b\u009c]*+(?:\x1b\\|\u009c|$)|\x1b[ -/]*+(?:[0-~]|$)"
)
_EIGHT_BIT = r"[\u0090\u0098\u009b\u009d-\u009f]"
#: Blanks of any script at either end.
_ENDS = r"(?U)^\s+|\s+$"
BAD = ("non_json", "truncated", "malformed")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that filters and projections above refer to, instead of computing them again.

    The optimizer moves a filter below the projection that makes its columns and so repeats them. It
    moves none below a generator; this one makes one row of each row.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def not_blank(line: Column | str) -> Column:
    return F.coalesce(F.col(line) if isinstance(line, str) else line, F.lit("")).rlike(r"(?U)\S")


def drop_blank(df: DataFrame, column: str = "line") -> DataFrame:
    """Leave out lines of blanks only (and null lines)."""
    return df.filter(not_blank(column))


def strip_ansi(line: Column | str) -> Column:
    """Remove terminal sequences; lines without an escape character, also of the 8-bit kind, are passed on untouched."""
    line = F.col(line) if isinstance(line, str) else line
    eight_bit = (F.octet_length(line) > F.length(line)) & line.rlike(_EIGHT_BIT)
    return F.when(F.contains(line, F.lit(_ESC)) | eight_bit, F.regexp_replace(line, _ANSI, "")).otherwise(line)


def clean(line: Column | str) -> Column:
    """Without terminal sequences and without blanks at the ends."""
    return F.regexp_replace(strip_ansi(line), _ENDS, "")


def classify_lines(df: DataFrame, column: str = "line", parsed: str | None = None) -> DataFrame:
    """Add ``clean`` and ``status``: blank, non_json, truncated, malformed or record.

    With ``parsed`` the variant that the test parses is kept under that name (null for no record), so
    that records need no second parse.

    A record is an object or an array that parses; text after its end is ignored. A line that starts
    like one and does not parse is truncated if it does not end like one, else malformed. A null line
    is blank.
    """
    out = computed_once(df, clean=F.coalesce(clean(column), F.lit("")))
    c, head, tail = F.col("clean"), F.substring("clean", 1, 1), F.substring("clean", -1, 1)
    whole = F.try_parse_json(c)
    if parsed:
        out = computed_once(out, **{parsed: F.when(head.isin("{", "["), whole)})
        whole = F.col(parsed)
    status = (
        F.when(c == "", "blank")
        .when(~head.isin("{", "["), "non_json")
        .when(whole.isNotNull(), "record")
        .when(~tail.isin("}", "]"), "truncated")
        .otherwise("malformed")
    )
    return out.withColumn("status", status)


def split_valid_invalid(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records, and the other lines that are not blank."""
    return classified.filter(F.col("status") == "record"), classified.filter(F.col("status").isin(*BAD))


def strict_fail(classified: DataFrame) -> DataFrame:
    """Records only; the job fails at a line that is neither record nor blank."""
    bad = F.col("status").isin(*BAD)
    checked = F.when(bad, F.raise_error(F.concat(F.col("status"), F.lit(" line: "), F.substring("line", 1, 80)))).otherwise(F.col("status"))
    return classified.withColumn("status", checked.cast("string")).filter(F.col("status") == "record")


def strict_prefix(classified: DataFrame, order: list[str]) -> DataFrame:
    """The records before the first line that is neither record nor blank, in the order of ``order``.

    The first bad line is one minimum of partial minima; that single row is broadcast.
    """
    cut = classified.filter(F.col("status").isin(*BAD)).agg(F.min(F.struct(*order)).alias("first_bad"))
    kept = classified.join(F.broadcast(cut), F.col("first_bad").isNull() | (F.struct(*order) < F.col("first_bad")))
    return kept.filter(F.col("status") == "record").drop("first_bad")


def take_lines(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` input lines, blank and bad ones included. Apply it before any filter.

    On a stream, where no order is known, use ``limit``: lines count as they arrive.
    """
    return df.orderBy(*order).limit(n)


def parse_quality_report(classified: DataFrame, order: str, by: list[str] | None = None, snippet: int = 40) -> DataFrame:
    """Per source and status: lines, the first of them, its start, and lines whose bytes are no valid UTF-8.

    ``error_class`` is the status of lines that are no records, else null.
    """
    group = [*(by or ["source"]), "status"]
    report = classified.groupBy(*group).agg(
        F.count("*").alias("lines"),
        F.min(order).alias("first_line"),
        F.min_by(F.substring("line", 1, snippet), order).alias("snippet"),
        F.sum((~F.is_valid_utf8("line")).cast("long")).alias("invalid_utf8"),
    )
    return report.withColumn("error_class", F.when(F.col("status").isin(*BAD), F.col("status")))


#: What is counted while lines pass by, with the line that it is counted from.
STATUSES = ("record", "blank", *BAD)


def observed_quality(classified: DataFrame, name: str = "quality") -> tuple[DataFrame, Observation]:
    """The same lines, and an observation that holds their counts once they are written: no pass of its own.

    On a stream name the metrics with ``classified.observe(name, *quality_metrics())``: each progress report carries them.
    """
    told = Observation(name)
    return classified.observe(told, *quality_metrics()), told


def quality_metrics() -> list[Column]:
    """Lines of each status, all lines, and those whose bytes are no valid UTF-8."""
    each = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES]
    return [*each, F.count(F.lit(1)).alias("lines"), F.count(F.when(~F.is_valid_utf8("line"), 1)).alias("invalid_utf8")]


def quality_row(spark: SparkSession, told: Observation) -> DataFrame:
    """What was observed, as a table of one row. Waits for the write that it is observed in."""
    got = told.get
    names = [*STATUSES, "lines", "invalid_utf8"]
    return spark.createDataFrame([tuple(got[n] for n in names)], ", ".join(f"{n} long" for n in names))

"""Records parsed once and kept: a table whose fields later reads take one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.functions.records import variant_field
from lograft.operators.cleaning import classify_lines


def keep_records(lines: DataFrame, path: str, column: str = "line", mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Parse ``lines`` and write the records as Parquet: their other columns, and ``v``, the record as a variant.

    Spark stores the fields that most records of a file have as columns of their own, typed, and the rest as it
    came, so nothing of a record is lost whatever its shape. ``by`` are columns that make folders.
    """
    records = classify_lines(lines, column, parsed="v").filter("status = 'record'").drop(column, "clean", "status")
    writer = records.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def kept_records(spark: SparkSession, path: str) -> DataFrame:
    """What ``keep_records`` wrote. ``kept_field`` and the other functions on variants apply to ``v``."""
    return spark.read.parquet(path)


def kept_field(path: str, kind: str = "string", record: Column | str = "v") -> Column:
    """The field at a path of a kept record. The scan reads the column of that field alone, and no record whole."""
    return variant_field(F.col(record) if isinstance(record, str) else record, path, kind)

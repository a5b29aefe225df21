"""Text sources and sinks of log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns that put lines of files in order, also where a file is read in several splits.
ORDER = ("source", "block_start", "nth")


def read_log_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source, block_start, nth, line`` for every line of the files; lines end at ``\\n`` only.

    Spark's text source numbers no lines. ``ORDER`` sorts them as they stand in each file: by file,
    start of the split, and a number that rises within it.
    """
    text = spark.read.text(path, lineSep="\n")
    return text.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("nth"),
        F.col("value").alias("line"),
    )


def stream_log_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """``source, block_start, line`` as a stream of the files that come to ``path``; lines keep no number."""
    reader = spark.readStream.option("lineSep", "\n")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block_start"), F.col("value").alias("line")
    )


def lines_from_table(*columns: Column | str, nulls: bool = False) -> Column:
    """One JSON object per row, in the order of ``columns``; null fields are left out unless ``nulls``."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": str(not nulls).lower()})


def write_lines(df: DataFrame, path: str, column: str = "text", mode: str = "errorifexists") -> None:
    """Write one line per row; null rows become empty lines."""
    df.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def write_quarantine(classified: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Keep the lines that are no records, unchanged, by status."""
    bad = classified.filter(~F.col("status").isin("record", "blank"))
    bad.write.mode(mode).partitionBy("status").parquet(path)

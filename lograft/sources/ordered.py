"""Lines of files in their order: true numbers, reading that ends early, and one output in the order of the input."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lograft.operators.cleaning import BAD, classify_lines
from lograft.sources.scratch import new_path

#: Names of local files are listed with an empty host, and read without.
_EMPTY_HOST = re.compile(r"(?<=^file):///")
#: What puts numbered lines in order.
NUMBERED = ("source", "line_no")
#: Splits up to which their first numbers are broadcast: 2^20 rows of some 150 bytes, that is 128 TB of files.
MOST_BROADCAST = 1 << 20
#: The names of output files carry a number of five digits.
MOST_PARTS = 99_999


# -- numbers -------------------------------------------------------------------------------------


def _text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, lineSep="\n")


def _placed(text: DataFrame) -> DataFrame:
    """Lines with their file, the split and task that read them, and a number that rises within the task."""
    return text.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("nth"),
        F.col("value").alias("line"),
    )


def _numbered(text: DataFrame, across: bool = False) -> DataFrame:
    spark, block, placed = text.sparkSession, ["source", "block_start", "part"], _placed(text)
    path = new_path(spark, "blocks")
    placed.groupBy(*block).agg(F.count("*").alias("n"), F.min("nth").alias("first")).write.parquet(path)
    blocks = spark.read.schema("source string, block_start long, part int, n long, first long").parquet(path)
    before = Window.orderBy("source", "block_start") if across else Window.partitionBy("source").orderBy("block_start")
    earlier = F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("before", earlier)
    starts = F.broadcast(starts) if blocks.count() <= MOST_BROADCAST else starts
    seen = placed.join(starts, block, "left")
    inside = F.col("nth") - F.col("first")
    known = F.coalesce((inside >= 0) & (inside < F.col("n")), F.lit(False))
    number = F.when(known, F.col("before") + inside + 1).otherwise(F.raise_error(F.lit("the files were split in another way than when their lines were counted")).cast("long"))
    return seen.select("source", number.alias("line_no"), "line")


def read_numbered_lines(spark: SparkSession, path: str | list[str], across: bool = False) -> DataFrame:
    """``source, line_no, line``: numbers from 1 without gaps in every file, or with ``across`` through all files by name.

    A first pass counts the lines of each split; sums over the splits before it give its first number, which
    meets the lines of the second pass by broadcast, so no line is shuffled. A second pass that
    splits the files in another way (a changed setting, or files that changed meanwhile) fails.
    """
    return _numbered(_text(spark, path), across)


# -- early end -----------------------------------------------------------------------------------


def _names(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files, by name, as ``source`` gives them."""
    return sorted({_EMPTY_HOST.sub(":/", n) for n in spark.read.text(path).inputFiles()})


def _waves(names: list[str], first: int) -> Iterator[tuple[str, str]]:
    """First and last name of ever more files: ``first``, twice as many, and so on."""
    at, wide = 0, max(1, first)
    while at < len(names):
        yield names[at], names[min(len(names), at + wide) - 1]
        at, wide = at + wide, wide * 2


def _between(text: DataFrame, first: str, last: str) -> DataFrame:
    """Lines of files by name; the scan leaves the other files out, as long as nothing that counts rows stands below the filter."""
    name = F.col("_metadata.file_path")
    return text.filter((name >= first) & (name <= last))


def _upto(source: str, line_no: int) -> Column:
    return (F.col("source") < source) | (F.col("source") == source) & (F.col("line_no") <= line_no)


def take_first_lines(spark: SparkSession, path: str | list[str], n: int, first_wave: int = 1) -> DataFrame:
    """``source, line_no, line`` of the first ``n`` lines, files by name; files behind them are not read.

    Waves of ever more files are counted until they hold ``n`` lines, so at most twice the files needed
    are counted; only those needed are then read.
    """
    names, text, seen = _names(spark, path), _text(spark, path), 0
    if n <= 0 or not names:
        return _numbered(text.filter(F.lit(False)))
    for first, last in _waves(names, first_wave):
        counts = dict(map(tuple, _between(text, first, last).groupBy("_metadata.file_path").count().collect()))
        for name in sorted(counts):
            if seen + counts[name] >= n:
                return _numbered(_between(text, names[0], name)).filter(_upto(name, n - seen))
            seen += counts[name]
    return _numbered(text)


def strict_prefix_lines(
    spark: SparkSession, path: str | list[str], first_wave: int = 1, classify: Callable[[DataFrame], DataFrame] = classify_lines
) -> DataFrame:
    """The records before the first line that is neither record nor blank, files by name; later files are not read.

    Each wave of ever more files gives its first bad line as one minimum; the first wave that has one ends the search.
    """
    names, text = _names(spark, path), _text(spark, path)
    for first, last in _waves(names, first_wave):
        wave = classify(_numbered(_between(text, first, last)))
        bad = wave.filter(F.col("status").isin(*BAD)).agg(F.min(F.struct(*NUMBERED)).alias("bad")).first()["bad"]
        if bad:
            kept = classify(_numbered(_between(text, names[0], bad["source"]))).filter(_upto(bad["source"], bad["line_no"] - 1))
            return kept.filter("status = 'record'")
    return classify(_numbered(text)).filter("status = 'record'")


# -- one output in order -------------------------------------------------------------------------


def in_order(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt by ranges of ``order`` and sorted within, so that partitions in turn hold them in order.

    Projections and filters above keep the order: deal the raw lines, which are small, and render them after.
    Spark finds the ranges by a sample, which reads the input once more.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n > MOST_PARTS:
        raise ValueError(f"names of files keep {MOST_PARTS} partitions in order")
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def echoed(classified: DataFrame, text: str = "text", line: str = "line") -> DataFrame:
    """What a reader of the log is shown, as ``value``: the text of records, bad lines as they came, blank lines not at all."""
    return classified.filter("status <> 'blank'").select(F.when(F.col("status") == "record", F.col(text)).otherwise(F.col(line)).alias("value"))


def write_in_order(df: DataFrame, path: str, column: str = "value", mode: str = "errorifexists") -> None:
    """Write one line per row of what ``in_order`` dealt; files, read by name, hold the rows in order. Null rows become empty lines."""
    df.select(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).write.mode(mode).option("lineSep", "\n").option("maxRecordsPerFile", 0).text(path)

"""Log lines as streams: the operators of this package on ``readStream``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lograft.operators.cleaning import BAD, classify_lines, observed_quality, quality_row
from lograft.sources.scratch import delete


def run_available(lines: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write what has come so far, classified (and transformed), as Parquet files; stateless, each line once."""
    out = classify_lines(lines)
    out = transform(out) if transform else out
    writer = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def route(lines: DataFrame, records: str, quarantine: str, checkpoint: str, strict: bool = False, report: str | None = None) -> StreamingQuery:
    """Each batch of a stream to two places: records, and lines that are none.

    With ``strict`` a batch that holds a bad line fails the query before anything of it is written. With
    ``report`` the counts that are observed while a batch is classified become its row of a third table; a
    batch that is run again replaces its row.
    """

    def write(batch: DataFrame, number: int) -> None:
        seen, told = observed_quality(classify_lines(batch), f"batch_{number}")
        seen = seen.persist()  # classified, and counted, once for all places
        try:
            bad = seen.filter(F.col("status").isin(*BAD))
            if strict and (first := bad.select("line").first()):
                raise ValueError(f"batch {number}: no record: {first['line'][:80]}")
            seen.filter("status = 'record'").write.mode("overwrite").parquet(f"{records}/batch={number}")
            bad.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
            if report:
                quality_row(batch.sparkSession, told).write.mode("overwrite").parquet(f"{report}/batch={number}")
        finally:
            seen.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns that give the place of a line in a batch, files by name.
_PLACE = ("source", "block_start", "nth")


def _folder() -> Column:
    return F.regexp_replace("source", "/[^/]*$", "")


def _stops(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, stop struct<source string, block_start long, nth long>").parquet(path)


def strict_prefix(lines: DataFrame, path: str, state: str, checkpoint: str, key: Column | None = None) -> StreamingQuery:
    """The records before the first bad line of each key (by default the folder of the file), as Parquet files.

    The state is one row per key, the place of its first bad line so far. It is a small table in the shared folder
    ``state``, written anew by each batch from that of the batch before, so a batch that is run again, or a
    query that starts again, finds the state it had. Lines of a key behind its stop are dropped as they come; only the
    stops are shuffled. A file that comes late but stands before the stop by name still gives its records; if it is
    bad itself, the stop moves there, and what was written behind it stays written.
    """
    key = key if key is not None else _folder()

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = classify_lines(batch.withColumn("nth", F.monotonically_increasing_id())).withColumn("key", key).persist()
        try:
            found = seen.filter(F.col("status").isin(*BAD)).groupBy("key").agg(F.min(F.struct(*_PLACE)).alias("stop"))
            if number:
                found = found.unionByName(_stops(spark, f"{state}/batch={number - 1}"))
            # a stop of an earlier batch is in another file, so its number in its task is never compared with one of this batch
            found.groupBy("key").agg(F.min("stop").alias("stop")).write.mode("overwrite").parquet(f"{state}/batch={number}")
            stops = _stops(spark, f"{state}/batch={number}")
            kept = seen.join(stops, "key", "left").filter(F.col("stop").isNull() | (F.struct(*_PLACE) < F.col("stop")))
            kept.filter("status = 'record'").drop("stop", "status", "nth").write.mode("overwrite").parquet(f"{path}/batch={number}")
            if number > 1:
                delete(spark, f"{state}/batch={number - 2}")
        finally:
            seen.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

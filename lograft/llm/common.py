"""What the corpus operators share: tables, durable cuts of lineage, joins on hot keys, words."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograft.sources.scratch import delete, new_path

#: Characters between words, as a Java regular expression; all others belong to words.
SPACE = r"[\x20\x09-\x0D]+"
#: Open scopes of ``scratch``, innermost last: the paths cut inside each.
_SCOPES: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The files outlive every executor, so a later stage never recomputes what lies before.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, size: int = 8 << 20) -> DataFrame:
    """``df``, after bounding the Arrow batches of its session by bytes: ten thousand long texts must not meet in one Python worker."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was cut inside. Results must be written by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            delete(spark, path)


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, share: float = 0.001, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (distinct ``key``, the number ``n`` of rows that have it, further columns).

    Keys that hold at least ``share`` of all rows are broadcast: there are at most ``1 / share`` of them,
    whatever the input, so no such key is shuffled into one task. All others meet by a shuffle.
    ``rows`` and ``keyed`` are read twice and so should be cut, or end in a shuffle that both reads share.
    ``total``, the number of all rows, is counted where it is not given. Where all keys are hot, or none
    is, there is one join, so that what follows plans half as much.
    """
    most = None
    if total is None:
        total, most = keyed.agg(F.sum("n"), F.max("n")).first()
    bound = max(1.0, share * (total or 0))
    if bound <= 1.0:
        return rows.join(F.broadcast(keyed.drop("n")), key)
    if most is not None and most < bound:
        return rows.join(keyed.drop("n").hint("merge"), key)
    hot = F.col("n") >= bound
    big = F.broadcast(keyed.filter(hot).drop("n"))
    return rows.join(big, key).unionByName(rows.join(big.select(key), key, "left_anti").join(keyed.filter(~hot).drop("n").hint("merge"), key))


def screened(rows: DataFrame, keys: DataFrame, key: Column, bits: int = 24, marks: int = 1) -> DataFrame:
    """Add ``maybe``: false only where ``key`` (a hash, of type long) is none of ``keys`` (one such column).

    A bitmap of ``2^bits`` places is broadcast as a table of at most ``2^(bits - 6)`` words, whatever
    the number of keys. Rows that can't be meant so pass an exact join by, with all their columns.
    Each key sets ``marks`` bits of one word: more of them pass fewer others, as long as most bits are unset.
    """
    hashed = lambda k: F.xxhash64(k, F.lit(77))
    word = F.shiftright(F.pmod(F.col("_hash"), F.lit(1 << bits)), 6).cast("int")
    at = [0, *(bits + 6 * i for i in range(marks - 1))]
    bit = lambda k: F.shiftrightunsigned("_hash", k).bitwiseAND(63).cast("int")
    mark = reduce(Column.bitwiseOR, (F.call_function("shiftleft", F.lit(1).cast("long"), bit(k)) for k in at))
    words = keys.select(hashed(F.col(keys.columns[0])).alias("_hash")).select(word.alias("_word"), mark.alias("_mark"))
    words = words.groupBy("_word").agg(F.expr("bit_or(_mark)").alias("_bits"))
    here = rows.withColumn("_hash", hashed(key)).withColumn("_word", word).withColumn("_mark", mark)
    found = here.join(F.broadcast(words), "_word", "left")
    seen = F.coalesce(F.col("_bits").bitwiseAND(F.col("_mark")) == F.col("_mark"), F.lit(False))
    return found.withColumn("maybe", seen).drop("_hash", "_word", "_mark", "_bits")


def words(text: Column | str) -> Column:
    """The words of a text, in order (null: none)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")

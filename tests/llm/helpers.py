"""Small tables for the corpus operators."""

from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=False):
    """Rows of (doc_id, text[, lang]); with ``extra`` also columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, COLUMNS)
    if extra:
        for n in ("fp", "id", "d", "g", "h", "z", "key", "nth", "mark", "runs", "list", "spans", "shard", "part", "rate", "seed", "item", "least", "root", "node", "count"):
            df = df.withColumn(n, F.lit("x"))
    return df


def rows_of(df):
    return [tuple(r) for r in df.collect()]

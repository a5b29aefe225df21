"""How the shape of records changes over time: a state per path that can be added up.

A record's shape is the text of its schema. There are few shapes beside records, so shapes are counted first,
and only distinct shapes are taken apart into paths.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

if TYPE_CHECKING:
    import pandas as pd

#: A quoted or plain name with its colon, the head of an object or array, the name of a type with its digits, an end.
_PIECE = re.compile(r"(?:`((?:[^`]|``)*)`|([^\s:<>,`()]+)): |(OBJECT|ARRAY)<|([A-Z_]+(?:\(\d+,\d+\))?)|>")
STATE = ("path", "kind")


def paths_of(shape: str) -> list[tuple[str, str]]:
    """Every path of a shape and its kind, once: names joined by dots, ``[]`` for what is in an array; the whole is ``$``."""
    out: dict[tuple[str, str], None] = {}
    open_: list[str] = []  # the path of each open object or array
    path, at = "$", 0
    while at < len(shape):
        m = _PIECE.match(shape, at)
        if not m:
            at += 1
            continue
        quoted, plain, group, kind = m.groups()
        if quoted is not None or plain is not None:
            path = f"{open_[-1]}.{quoted.replace('``', '`') if quoted is not None else plain}"
        elif group:
            out[path, group.lower()] = None
            open_.append(path)
            path += "[]" if group == "ARRAY" else ""
        elif kind:
            out[path, re.sub(r"\(.*", "", kind).lower()] = None
        else:
            open_.pop()
        at = m.end()
    return list(out)


def shapes(df: DataFrame, variant: str = "v", order: str = "line_no") -> DataFrame:
    """``shape, records, first_line, last_line``: a partial aggregation over the records, one row a shape."""
    shape = F.schema_of_variant(F.col(variant))
    return df.groupBy(shape.alias("shape")).agg(F.count("*").alias("records"), F.min(order).alias("first_line"), F.max(order).alias("last_line"))


def _taken_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pandas as pd

    for b in batches:
        rows = [(p, k, r.records, r.first_line, r.last_line) for r in b.itertuples() for p, k in paths_of(r.shape)]
        yield pd.DataFrame(rows, columns=[*STATE, "records", "first_line", "last_line"])


def drift_state(df: DataFrame, variant: str = "v", order: str = "line_no") -> DataFrame:
    """``path, kind, records, first_line, last_line``: how many records hold a path as that kind, and the first and last of them.

    An explicit null is of kind ``void``; what an array holds in unlike kinds is ``variant``. ``order`` is a long.
    """
    seen = shapes(df.filter(F.col(variant).isNotNull()), variant, order)
    return merged(seen.mapInPandas(_taken_apart, "path string, kind string, records long, first_line long, last_line long"))


def merged(states: DataFrame) -> DataFrame:
    """One state of the rows of many: that of two halves is that of the whole."""
    return states.groupBy(*STATE).agg(F.sum("records").alias("records"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, kind, change``: what is ``new`` in the later state and what is ``gone``."""
    b, a = before.select(*STATE), after.select(*STATE)
    mark = lambda df, word: df.withColumn("change", F.lit(word))
    return mark(a.join(b, list(STATE), "left_anti"), "new").unionByName(mark(b.join(a, list(STATE), "left_anti"), "gone"))


def watch(records: DataFrame, path: str, checkpoint: str, variant: Callable[[DataFrame], Column], order: str = "line_no") -> StreamingQuery:
    """The state of each batch of a stream as a table under ``path``; ``merged`` of all is the state so far."""

    def write(batch: DataFrame, number: int) -> None:
        drift_state(batch.withColumn("v", variant(batch)), "v", order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

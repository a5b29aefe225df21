"""The normalised log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograft.functions import records as R
from lograft.functions.paths import parse_path

#: Fields that give each column, the first that is there.
TIMESTAMP = ("timestamp",)
LEVEL = ("level", "lvl", "severity")
MESSAGE = ("message", "msg", "body", "fields.message")
#: Level names in order of rank, from 0.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR")


def severity(level: Column | str) -> Column:
    """The level in capitals if it is one of ``LEVELS`` in capitals or in small letters, else null."""
    level = F.col(level) if isinstance(level, str) else level
    return F.when(level.isin(*LEVELS, *(x.lower() for x in LEVELS)), F.upper(level))


def severity_rank(level: Column | str) -> Column:
    return (F.array_position(F.array(*map(F.lit, LEVELS)), severity(level)) - 1).cast("int")


def pad_level(level: Column | str, width: int = 5) -> Column:
    """The level moved right to ``width``; longer ones stay whole."""
    level = F.col(level) if isinstance(level, str) else level
    return F.when(F.length(level) < width, F.lpad(level, width, " ")).otherwise(level)


def normalize_log(df: DataFrame, record: str = "r") -> DataFrame:
    """Add ``timestamp, level, message`` and ``data``, the rest of the record as JSON without what the others took."""
    schema, r = df.schema[record].dataType, F.col(record)
    used: R.Used = {}
    for options in (TIMESTAMP, LEVEL, MESSAGE):
        earlier = F.lit(False)
        for o in options:
            if R.type_at(schema, parse_path(o)) is not None:
                col = R.field(r, schema, o)
                used[parse_path(o)] = col.isNotNull() & ~earlier
                earlier = earlier | col.isNotNull()
    return df.withColumns({
        "timestamp": R.first_of(r, schema, *TIMESTAMP),
        "level": R.first_of(r, schema, *LEVEL),
        "message": R.first_of(r, schema, *MESSAGE),
        "data": R.to_compact_json(R.without(r, schema, used), schema),
    })

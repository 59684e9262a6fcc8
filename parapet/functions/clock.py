"""Time as whole microseconds, free of the session time zone for zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, with or without zone."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.LongType):
        return F.col(name)
    if isinstance(kind, T.TimestampNTZType):
        since = F.col(name) - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return (since.cast("interval second").cast("decimal(20,6)") * 1000000).cast("bigint")
    return F.unix_micros(F.col(name))


def from_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros)


def slot(micros: Column, width: int) -> Column:
    """Index of the ``width``-microsecond slot a time falls in (exact integer arithmetic, also before 1970)."""
    return F.floor((micros - F.pmod(micros, F.lit(width))) / F.lit(width)).cast("bigint")

"""Instants written in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant_micros(text: Column) -> Column:
    """Microseconds since 1970 of an instant given as text; null where it can't be read.

    A bare number is seconds since 1970, a time without an offset is UTC whatever the session's
    time zone is, a date alone is its midnight. Null and blank text give null.
    """
    t = F.trim(text)
    zoned = (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z")))
        .when(t.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$"), t)
        .otherwise(F.concat(t, F.lit("Z")))
    )
    number = F.expr("try_cast(1 as decimal(20,6))") * 0 + t.try_cast("decimal(20,6)")
    return F.when(t.rlike(r"^[+-]?\d+(\.\d+)?$"), (number * 1000000).try_cast("bigint")).otherwise(
        F.unix_micros(zoned.try_cast("timestamp"))
    )

"""Small expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation_label(r: Column) -> Column:
    """Strength of a correlation, with its sign; the names are fixed values."""
    size = F.abs(r)
    name = F.when(size >= 0.9, "Very strong").when(size >= 0.7, "Strong").when(size >= 0.4, "Moderate").when(size >= 0.2, "Weak")
    signed = F.concat(name, F.when(r >= 0, " positive").otherwise(" negative"))
    return F.when(r.isNull(), None).otherwise(F.coalesce(signed, F.lit("No correlation")))


def error_band(pct: Column) -> Column:
    """Band of an error in percent, either sign."""
    size = F.abs(pct)
    return F.when(size < 2, "good").when(size < 5, "fair").when(size.isNotNull(), "poor")


def next_five_minutes(ts: Column) -> Column:
    """The next 5-minute boundary, strictly after ts."""
    return F.timestamp_seconds((F.floor(F.unix_timestamp(ts) / 300) + 1) * 300)

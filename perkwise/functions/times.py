"""Moments as literals, so that comparisons with them reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_MICROS = 86_400_000_000


def instant(moment: str) -> Column:
    """A timestamp literal in the session time zone."""
    return F.lit(moment).cast("timestamp")


def before(moment: str, days: float) -> Column:
    """The moment so many 24-hour days earlier."""
    return F.timestamp_micros(F.unix_micros(instant(moment)) - F.lit(int(days * DAY_MICROS)))


def elapsed_days(ts: Column, moment: str) -> Column:
    """Whole 24-hour periods from ``ts`` to the moment, never negative."""
    micros = F.unix_micros(instant(moment)) - F.unix_micros(ts)
    return F.greatest(F.floor(micros / F.lit(DAY_MICROS)), F.lit(0)).cast("int")

"""Instants as microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Signed seconds as double, exact to the microsecond."""
    return (micros(later) - micros(earlier)) / F.lit(float(SECOND))


def first_tick_after(ts: Column, delay_s: int) -> Column:
    """The first whole second strictly later than ``ts + delay_s``, in microseconds."""
    return (F.floor((micros(ts) + F.lit(delay_s * SECOND)) / F.lit(SECOND)) + 1) * F.lit(SECOND)

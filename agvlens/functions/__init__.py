"""Scalar column functions shared by the operators."""

from .once import evaluated_once
from .text import fixed3_text_sql, float_text, float_text_sql, iso_utc
from .times import micros, seconds_between, from_micros, first_tick_after

__all__ = [
    "evaluated_once",
    "fixed3_text_sql", "float_text", "float_text_sql", "iso_utc", "micros", "seconds_between", "from_micros",
    "first_tick_after",
]

"""Number and timestamp text, in the forms the anomaly details and the feed use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# As SQL text, so that an expression this size reaches the JVM in one call.
_FLOAT_TEXT = r"""
case when abs({x}) >= 1e-3 and abs({x}) < 1e7 or {x} = 0 or not contains(cast({x} as string), 'E')
  then cast({x} as string)
when abs({x}) >= 1e-4 and abs({x}) < 1e16
  then regexp_replace(cast(cast(cast({x} as string) as decimal(38,20)) as string), '([.][0-9]+?)0+$', '$1')
else replace(replace(
    regexp_replace(replace(cast({x} as string), '.0E', 'E'), 'E(-?)([0-9])$', 'E$10$2'), 'E-', 'e-'), 'E', 'e+')
end"""


def float_text_sql(x: str) -> str:
    """A double as shortest decimal text: plain between 1e-4 and 1e16, ``1e-05`` style outside.

    Spark's own cast writes ``1.0E-4`` below 1e-3 and from 1e7 on; such rows are rewritten,
    through a decimal wide enough for every digit in the plain range.
    """
    return "(" + _FLOAT_TEXT.format(x=x).strip() + ")"


def float_text(name: str) -> Column:
    return F.expr(float_text_sql(name))


def fixed3_text_sql(x: str) -> str:
    """Three decimals, rounding the exact binary value (``format_string`` rounds halves up)."""
    return f"format_number({x}, '0.000')"


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with microseconds; the session time zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")

"""Keeping the optimizer from repeating costly expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluated_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column as a generator of one row.

    A filter on a plain column is moved below its projection by copying the expression, a JSON
    parse say, into every place that refers to it; it is not moved below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))

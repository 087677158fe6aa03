"""Small fixed tables, known to the optimizer as local data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def constant_rows(spark: SparkSession, columns: str, rows: Iterable[tuple[int, str]]) -> DataFrame:
    """(number, name) rows as an inline table: no Python data to ship, exact size in the plan."""
    values = ", ".join(f"({number}, '{name}')" for number, name in rows)
    return spark.sql(f"select * from values {values} as t({columns})")

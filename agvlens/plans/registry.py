"""Collects queries together with the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from ..sources.driver_tables import DriverTables
from .oracle_views import with_views

Build = Callable[[DriverTables], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _zone_less(df: DataFrame) -> DataFrame:
    """Instants as plain UTC timestamps, the type the SQL side produces."""
    return df.select([
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f.name)
        for f in df.schema.fields
    ])


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register ``build`` under ``name``; ``sql`` may name any view of ``oracle_views``."""
    def register(build: Build) -> Build:
        QUERIES[name] = lambda spark, sf_dir: _zone_less(build(DriverTables(spark, sf_dir)))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register

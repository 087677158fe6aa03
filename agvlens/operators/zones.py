"""Zone entry counters over the append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ZONES, SkewPolicy
from .constants import constant_rows
from .skew import every_key, no_hot_keys, with_running_sum


def zones_table(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, "ord, zone_id", enumerate(ZONES))


def seed_zones(existing: DataFrame) -> DataFrame:
    """Existing counters, plus a zero for each known zone that has none; nothing is reset."""
    known = zones_table(existing.sparkSession).select("zone_id")
    absent = known.join(existing, "zone_id", "left_anti").withColumn("entry_count", F.lit(0).cast("long"))
    return existing.unionByName(absent)


def crossings(telemetry: DataFrame) -> DataFrame:
    """Readings that entered a known zone; 20 names go into the scan as a filter."""
    return telemetry.filter(F.col("zone_entered").isin(*ZONES))


def entries_per_zone(telemetry: DataFrame) -> DataFrame:
    return crossings(telemetry).groupBy(F.col("zone_entered").alias("zone_id")).agg(
        F.count(F.lit(1)).alias("entry_count"))


def zone_counts(telemetry: DataFrame) -> DataFrame:
    """Entries of each known zone, zero included."""
    return seed_zones(entries_per_zone(telemetry))


def unknown_zone_entries(telemetry: DataFrame) -> DataFrame:
    """Entries the counters ignore, made visible."""
    known = F.broadcast(zones_table(telemetry.sparkSession).select(F.col("zone_id").alias("zone_entered")))
    stray = telemetry.filter(F.col("zone_entered").isNotNull()).join(known, "zone_entered", "left_anti")
    return stray.groupBy(F.col("zone_entered").alias("zone_id")).agg(F.count(F.lit(1)).alias("entry_count"))


def running_counts(telemetry: DataFrame, base: DataFrame | None = None, policy: SkewPolicy = SkewPolicy(),
                   small: bool = False) -> DataFrame:
    """Each crossing with its zone's counter right after it: (seq, zone_id, entry_count, recorded_at).

    ``base`` holds the counters before the first reading (default: zero). There are only
    20 zones, so each one is counted in slices, unless the caller knows the log to be ``small``
    (at most ``policy.hot_rows`` readings).
    """
    entered = crossings(telemetry).select(
        "seq", F.col("zone_entered").alias("zone_id"), "recorded_at")
    split = no_hot_keys("zone_id") if small else every_key("zone_id")
    counted = with_running_sum(entered, split, ["seq"], F.lit(1).cast("long"), "entry_count",
                               policy=policy)
    if base is None:
        return counted
    start = base.select("zone_id", F.col("entry_count").alias("_start"))
    # counters of the known zones: 20 rows
    joined = counted.join(F.broadcast(start.filter(F.col("zone_id").isin(*ZONES))), "zone_id", "left")
    return joined.withColumn("entry_count", F.col("entry_count") + F.coalesce("_start", F.lit(0))).drop("_start")

"""Sinks: the raw log, published state versions, and the feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import Folder


def append_raw_log(telemetry: DataFrame, path: str, mode: str = "append") -> None:
    """Append full readings, partitioned by day.

    No shuffle: a task writes one file per day it holds, and an arriving log spans few days
    per task. Compact with :func:`cluster_raw_log`.
    """
    telemetry.withColumn("dt", F.to_date("recorded_at")).write.mode(mode).partitionBy("dt").parquet(path)


def cluster_raw_log(telemetry: DataFrame, path: str) -> None:
    """Rewrite readings so that row-group statistics prune by vehicle within each day.

    The range exchange samples (dt, vehicle_id, seq), so a hot vehicle is cut too.
    """
    (
        telemetry.withColumn("dt", F.to_date("recorded_at"))
        .repartitionByRange("dt", "vehicle_id", "seq").sortWithinPartitions("dt", "vehicle_id", "seq")
        .write.mode("overwrite").partitionBy("dt").parquet(path)
    )


def publish_version(df: DataFrame, root: str, version: int) -> None:
    """Write a complete table version, then its marker, then the pointer to the newest; readers see it only with the marker."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    marks = Folder(f"{root}-committed")
    marks.put(str(version), "")
    if not marks.exists("newest") or int(marks.text("newest")) < version:
        marks.put("newest", str(version))


def read_at_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The table as of one committed version (default: the last); asks for that version's marker alone, however many there are."""
    marks = Folder(f"{root}-committed")
    if version is None and marks.exists("newest"):
        version = int(marks.text("newest"))
    if version is None or not marks.exists(str(version)):
        raise LookupError(f"no committed version {version} under {root}")
    return spark.read.parquet(f"{root}/version={version}")


def feed_to_messages(feed: DataFrame) -> DataFrame:
    """Change-feed rows as (key, value) messages for a Kafka or file sink."""
    entity = F.coalesce(F.get_json_object("payload", "$.vehicle_id"), F.get_json_object("payload", "$.zone_id"))
    value = F.concat(
        F.lit('{"type":"'), F.col("type"), F.lit('","payload":'), F.col("payload"), F.lit("}"))
    return feed.select(entity.alias("key"), value.alias("value"), "seq", "slot")

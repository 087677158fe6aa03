"""Queries over the anomalies table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_type(anomalies: DataFrame, *by: str) -> DataFrame:
    """Rows per anomaly type, or per any of ``by`` (e.g. ``vehicle_id``, ``anomaly_type``)."""
    return anomalies.groupBy(*(by or ("anomaly_type",))).agg(F.count(F.lit(1)).alias("n"))


def latest_per_vehicle(anomalies: DataFrame) -> DataFrame:
    """The newest anomaly of each vehicle; of several at one instant, the one written last."""
    newest = F.max_by(
        F.struct("anomaly_type", "detail", "detected_at"), F.struct("detected_at", "seq", "rule_ord"))
    return anomalies.groupBy("vehicle_id").agg(newest.alias("a")).select("vehicle_id", "a.*")


def _instant(value: datetime | str, name: str) -> datetime:
    try:
        parsed = datetime.fromisoformat(value) if isinstance(value, str) else value
    except ValueError as e:
        raise ValueError(f"{name}: not a timestamp: {value!r}") from e
    if not isinstance(parsed, datetime):
        raise ValueError(f"{name}: not a timestamp: {value!r}")
    return parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)


def recent(anomalies: DataFrame, vehicle_id: str, since: datetime | str, until: datetime | str) -> DataFrame:
    """One vehicle's anomalies within [since, until], oldest first; zone-less bounds are UTC."""
    if not vehicle_id:
        raise ValueError("vehicle_id: must not be empty")
    lo, hi = _instant(since, "since"), _instant(until, "until")
    wanted = (F.col("vehicle_id") == vehicle_id) & F.col("detected_at").between(F.lit(lo), F.lit(hi))
    return anomalies.filter(wanted).orderBy("detected_at", "seq", "rule_ord").select(
        "vehicle_id", "anomaly_type", "detail", "detected_at")


def checked_parameters(parameters: DataFrame) -> DataFrame:
    """Query parameters (query_id, vehicle_id, since, until; the bounds as text) with their instants and ``reject_reason``.

    The same checks as :func:`recent`, first reason first; zone-less bounds are UTC, the session's time zone.
    """
    instant = lambda c: F.try_to_timestamp(F.translate(c, "Tt", "  "))
    checked = parameters.withColumns({"since_ts": instant("since"), "until_ts": instant("until")})
    reason = (
        F.when(F.coalesce(F.col("vehicle_id"), F.lit("")) == "", "vehicle_id")
        .when(F.col("since_ts").isNull(), "since").when(F.col("until_ts").isNull(), "until"))
    return checked.withColumn("reject_reason", reason)


def recent_for(anomalies: DataFrame, parameters: DataFrame, buckets: int = 64) -> DataFrame:
    """The anomalies of many queries at once: (query_id, seq, rule_ord, vehicle_id, anomaly_type, detail, detected_at).

    Rows are joined by vehicle and time bucket, so neither a vehicle with very many anomalies nor one that very many queries ask for
    meets in one task whole. The span of the anomalies is cut into ``buckets``; a query is listed in those it reaches.
    Rejected parameters give no rows.
    """
    span = anomalies.agg(F.min(F.unix_micros("detected_at")).alias("lo"), F.max(F.unix_micros("detected_at")).alias("hi")).first()  # two values
    lo, hi = (0, 0) if span["lo"] is None else span
    width = (hi - lo) // buckets + 1
    place = lambda us: F.expr(f"({us} - {lo}) div {width}")
    good = checked_parameters(parameters).filter("reject_reason is null").select(
        "query_id", "vehicle_id", F.unix_micros("since_ts").alias("a"), F.unix_micros("until_ts").alias("b"))
    reached = good.withColumns({"x": F.greatest("a", F.lit(lo)), "y": F.least("b", F.lit(hi))}).filter("x <= y")
    listed = reached.withColumn("bucket", F.explode(F.sequence(place("x"), place("y")))).drop("x", "y")
    rows = anomalies.withColumn("us", F.unix_micros("detected_at")).withColumn("bucket", place("us"))
    return rows.join(listed, ["vehicle_id", "bucket"]).filter("us between a and b").select(
        "query_id", "seq", "rule_ord", "vehicle_id", "anomaly_type", "detail", "detected_at")

"""Current state per vehicle, the fleet aggregate, and the previous reading of each reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STATUSES, SkewPolicy
from ..functions import seconds_between
from .constants import constant_rows
from .skew import HotKeys, find_hot_keys, with_neighbour

PRIOR = "prior"
PRIOR_FIELDS = ["status", "battery_pct", "speed_mps", "pos_x", "pos_y", "recorded_at"]
STATE_FIELDS = ["status", "battery_pct", "recorded_at", "speed_mps", "pos_x", "pos_y", "seq"]


def statuses_table(spark: SparkSession) -> DataFrame:
    return constant_rows(spark, "ord, status", enumerate(STATUSES))


def current_state(telemetry: DataFrame) -> DataFrame:
    """The last arrived reading of each vehicle; ``recorded_at`` plays no part in the choice."""
    last = telemetry.groupBy("vehicle_id").agg(F.max_by(F.struct(*STATE_FIELDS), "seq").alias("s"))
    return last.select(
        "vehicle_id", *[F.col(f"s.{f}").alias(f) for f in STATE_FIELDS[:-1]], F.col("s.seq").alias("last_seq"))


def status_code(status: Column) -> Column:
    """Position in STATUSES (0..3); 4 for any other status."""
    code = F.when(status == STATUSES[0], 0)
    for i, name in enumerate(STATUSES[1:], 1):
        code = code.when(status == name, i)
    return code.otherwise(len(STATUSES))


def last_status(rows: DataFrame, key: str = "vehicle_id", order: str = "seq") -> DataFrame:
    """Last status per key, null for one that is not among STATUSES.

    The status travels in the low bits of the order, so the aggregate is ``max`` over one
    long: a hash aggregate, where ``max_by`` over text would sort every task's input first.
    """
    packed = F.max(F.col(order) * 8 + status_code(F.col("status")))
    names = F.array(*[F.lit(s) for s in STATUSES])
    return rows.groupBy(key).agg(packed.alias("p")).select(
        key, F.get(names, F.pmod("p", F.lit(8)).cast("int")).alias("status"))


def status_counts(per_vehicle: DataFrame) -> DataFrame:
    """Vehicles per status; statuses nobody is in count zero."""
    counts = per_vehicle.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    known = statuses_table(per_vehicle.sparkSession)  # 4 rows; the counts have at most 4 too
    return known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def fleet_state(telemetry: DataFrame) -> DataFrame:
    return status_counts(last_status(telemetry))


def fleet_size_check(telemetry: DataFrame) -> DataFrame:
    """The per-status counts must add up to the number of distinct vehicles."""
    vehicles = telemetry.select("vehicle_id").distinct().select(
        F.lit(0).cast("long").alias("fleet"), F.lit(1).cast("long").alias("vehicle"))
    fleet = fleet_state(telemetry).select(F.col("n").alias("fleet"), F.lit(0).cast("long").alias("vehicle"))
    sums = fleet.unionByName(vehicles).agg(F.sum("fleet").alias("fleet_total"), F.sum("vehicle").alias("vehicles"))
    return sums.withColumn("consistent", F.col("fleet_total") == F.col("vehicles"))


def vehicle_list(state: DataFrame) -> DataFrame:
    return state.select("vehicle_id", "status", "battery_pct").orderBy("vehicle_id")


def events_per_vehicle(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n_events"))


def with_prior(telemetry: DataFrame, hot: HotKeys | None = None, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Add the vehicle's previous arrived reading as ``prior_*``; ``prior_seq`` is null for its first."""
    if hot is None:
        hot = find_hot_keys(telemetry, "vehicle_id", policy=policy)
    return with_neighbour(telemetry, hot, ["seq"], PRIOR_FIELDS, PRIOR, policy=policy)


def gap_seconds() -> Column:
    """Seconds since the prior reading; negative when readings arrive out of order."""
    return seconds_between(F.col("recorded_at"), F.col(f"{PRIOR}_recorded_at"))


def late_readings(with_prior_df: DataFrame) -> DataFrame:
    """Per vehicle, the readings that are not newer than the one that arrived before them."""
    gap = gap_seconds()
    return with_prior_df.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("readings"),
        F.count_if(gap <= 0).alias("late_readings"),
        F.max(F.when(gap <= 0, -gap)).alias("max_late_s"),
    )

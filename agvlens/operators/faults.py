"""Status commands and what a transition to fault does to missions and maintenance records.

All commands of a vehicle are ordered by ``seq`` and every accepted one leaves the vehicle
in the status it names, so a command's prior status is that of the command before it, or
the vehicle's initial status for the first. No lock and no sequential state is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MISSION_STATUSES, SkewPolicy
from .skew import HotKeys, find_hot_keys, join_dimension, with_neighbour
from .state import last_status

ACTIVE, CANCELLED, _ = MISSION_STATUSES


def outcomes(commands: DataFrame, vehicles: DataFrame, hot: HotKeys | None = None,
             policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Each command with its prior status and outcome: applied, noop, or unknown_vehicle."""
    if hot is None:
        hot = find_hot_keys(commands, "vehicle_id", policy=policy)
    ordered = with_neighbour(commands, hot, ["seq"], ["status"], "last", policy=policy)
    initial = vehicles.select("vehicle_id", F.col("status").alias("_initial"))
    joined = join_dimension(ordered, initial, hot, "seq", "left", policy)
    known = F.col("_initial").isNotNull()
    prior = F.when(known, F.coalesce(F.col("last_status"), F.col("_initial")))
    repeated = (F.col("status") == "fault") & (F.col("prior_status") == "fault")
    return joined.withColumn("prior_status", prior).select(
        "seq", "vehicle_id", "status", "reason", "prior_status",
        F.when(F.col("prior_status").isNull(), "unknown_vehicle").when(repeated, "noop")
        .otherwise("applied").alias("outcome"),
    )


def transitions(resolved: DataFrame) -> DataFrame:
    """Commands that actually moved a vehicle into fault."""
    return resolved.filter((F.col("status") == "fault") & (F.col("outcome") == "applied")).select(
        "seq", "vehicle_id", "prior_status", "reason")


def first_transitions(moves: DataFrame) -> DataFrame:
    """The earliest transition per vehicle: (vehicle_id, seq, reason)."""
    first = moves.groupBy("vehicle_id").agg(F.min_by(F.struct("seq", "reason"), "seq").alias("f"))
    return first.select("vehicle_id", "f.seq", "f.reason")


def missions_after(missions: DataFrame, moves: DataFrame) -> DataFrame:
    """Missions with the active ones of faulted vehicles cancelled.

    Finished missions cannot change and bypass the join; active ones are at most one per
    vehicle, as are the vehicles that faulted.
    """
    faulted = moves.select("vehicle_id").distinct().withColumn("_faulted", F.lit(True))
    active = missions.filter(F.col("status") == ACTIVE).join(faulted, "vehicle_id", "left")
    status = F.when(F.col("_faulted"), CANCELLED).otherwise(F.col("status"))
    changed = active.withColumn("status", status).drop("_faulted")
    return missions.filter(F.col("status") != ACTIVE).unionByName(changed)


def maintenance_opened(moves: DataFrame, missions: DataFrame, open_records: DataFrame) -> DataFrame:
    """The record opened per faulted vehicle, unless it already has an open one.

    The mission is the one the transition cancelled, null if none was active.
    """
    fresh = first_transitions(moves).join(open_records.select("vehicle_id").distinct(), "vehicle_id", "left_anti")
    # one row even where the one-active rule is broken upstream
    active = missions.filter(F.col("status") == ACTIVE).groupBy("vehicle_id").agg(
        F.min("mission_id").alias("mission_id"))
    return fresh.join(active, "vehicle_id", "left").select(
        "vehicle_id", "mission_id", "reason", F.col("seq").alias("opened_seq"))


def vehicles_after(commands: DataFrame, vehicles: DataFrame, order: str = "seq") -> DataFrame:
    """Vehicles in the status of their last command; commands to unknown vehicles do nothing."""
    final = last_status(commands, order=order).withColumnRenamed("status", "_final")
    return vehicles.join(final, "vehicle_id", "left").select(
        "vehicle_id", F.coalesce("_final", "status").alias("status"))


def is_open() -> Column:
    return F.col("resolved_at").isNull()


def integrity_violations(missions: DataFrame, records: DataFrame) -> DataFrame:
    """Vehicles with more than one active mission or more than one open record."""
    def over_one(df: DataFrame, rule: str) -> DataFrame:
        counts = df.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n"))
        return counts.filter(F.col("n") > 1).select(F.lit(rule).alias("rule"), "vehicle_id", "n")

    return over_one(missions.filter(F.col("status") == ACTIVE), "one_active_mission").unionByName(
        over_one(records.filter(is_open()), "one_open_record"))


def mission_counts(missions: DataFrame) -> DataFrame:
    return missions.groupBy("vehicle_id", "status").agg(F.count(F.lit(1)).alias("n"))


def maintenance_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(is_open()).alias("open_records"),
        F.count_if(~is_open()).alias("resolved_records"))

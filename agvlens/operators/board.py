"""The dashboard's view: a snapshot, and the feed folded onto it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ANOMALY_DETECTED, DISPLAY_LOW_BATTERY, VEHICLE_STATE_CHANGED, ZONE_COUNT_CHANGED


def _latest(patches: DataFrame, kind: str, key: str, fields: list[str]) -> DataFrame:
    """The last patch per id that has the first of ``fields``; combined map-side, so a hot id is no burden."""
    rows = patches.filter(F.col("type") == kind).select("seq", "slot", "payload.*").filter(F.col(fields[0]).isNotNull())
    last = F.max_by(F.struct(*fields), F.struct("seq", "slot"))
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(last.alias("patch"))


def _overwrite(snapshot: DataFrame, latest: DataFrame, key: str, fields: list[str]) -> DataFrame:
    pick = [
        F.when(F.col("patch").isNotNull(), F.col(f"patch.{f}")).otherwise(F.col(f)).alias(f) for f in fields
    ]
    return snapshot.join(latest, key, "left").select(key, *pick)


def fold_vehicles(snapshot: DataFrame, patches: DataFrame) -> DataFrame:
    """Vehicles of the snapshot in their last patched state; other ids are ignored."""
    fields = ["status", "battery_pct"]
    return _overwrite(snapshot, _latest(patches, VEHICLE_STATE_CHANGED, "vehicle_id", fields), "vehicle_id", fields)


def fold_zones(snapshot: DataFrame, patches: DataFrame) -> DataFrame:
    fields = ["entry_count"]
    return _overwrite(snapshot, _latest(patches, ZONE_COUNT_CHANGED, "zone_id", fields), "zone_id", fields)


def fold_anomalies(snapshot: DataFrame, patches: DataFrame) -> DataFrame:
    """Latest anomaly per vehicle; a patch for a vehicle without one adds it."""
    fields = ["anomaly_type", "detail", "detected_at"]
    latest = _latest(patches, ANOMALY_DETECTED, "vehicle_id", fields)
    pick = [F.when(F.col("patch").isNotNull(), F.col(f"patch.{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    return snapshot.join(latest, "vehicle_id", "full").select("vehicle_id", *pick)


#: Per patch type: the id of what it changes, the fields it sets (the first is required), and whether it may add what the snapshot lacks.
PARTS = {
    VEHICLE_STATE_CHANGED: ("vehicle_id", ("status", "battery_pct"), False),
    ZONE_COUNT_CHANGED: ("zone_id", ("entry_count",), False),
    ANOMALY_DETECTED: ("vehicle_id", ("anomaly_type", "detail", "detected_at"), True),
}


FIELDS = tuple(f for _, own, _ in PARTS.values() for f in own)


def patch_rows(patches: DataFrame) -> DataFrame:
    """Typed patches as (type, id, place, FIELDS): those that name an id and set their part's required field."""
    kind, ids, required = F.col("type"), F.lit(None).cast("string"), F.lit(False)
    for t, (key, own, _) in PARTS.items():
        ids = F.when(kind == t, F.col(f"payload.{key}")).otherwise(ids)
        required = F.when(kind == t, F.col(f"payload.{own[0]}").isNotNull()).otherwise(required)
    place = F.struct(F.col("seq").cast("long").alias("seq"), F.col("slot").cast("int").alias("slot"))
    return patches.filter(required).select(
        "type", ids.alias("id"), place.alias("place"), *[F.col(f"payload.{f}").alias(f) for f in FIELDS]).filter(F.col("id").isNotNull())


def snapshot_rows(vehicles: DataFrame, zones: DataFrame, anomalies: DataFrame) -> DataFrame:
    """A snapshot's three tables as (type, id, FIELDS)."""
    first = dict(zip(PARTS, (vehicles, zones, anomalies), strict=True))
    parts = [first[t].select(F.lit(t).alias("type"), F.col(key).alias("id"), *own) for t, (key, own, _) in PARTS.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def may_be_added() -> Column:
    """Whether a patch of this type may add what the snapshot lacks."""
    return F.col("type").isin(*[t for t, (_, _, may_add) in PARTS.items() if may_add])


def fold(vehicles: DataFrame, zones: DataFrame, anomalies: DataFrame, patches: DataFrame) -> DataFrame:
    """The whole board after ``patches``: (type, id, fields of all parts), as the three folds above give it.

    Snapshot rows stand before any patch, so the last row per (type, id) is the state: one parse of the feed, one
    aggregate that combines before its only shuffle, no join.
    """
    known = snapshot_rows(vehicles, zones, anomalies).withColumns({"known": F.lit(True), "place": F.lit(None).cast("struct<seq:bigint,slot:int>")})
    rows = patch_rows(patches).withColumn("known", F.lit(False)).unionByName(known, allowMissingColumns=True)
    # the order is a struct, as max_by passes over rows whose order is null
    last = F.max_by(F.struct(*FIELDS), F.struct(~F.col("known"), "place")).alias("last")
    folded = rows.groupBy("type", "id").agg(F.max("known").alias("known"), last)
    return folded.filter(F.col("known") | may_be_added()).select("type", "id", "last.*")


def snapshot_envelope(status_counts: DataFrame, zone_counts: DataFrame) -> DataFrame:
    """One row: type 'snapshot', and the fleet (4 keys) and zone (20 keys) maps as payload."""
    entries = status_counts.select(F.lit("fleet").alias("part"), F.struct(
        F.col("status").alias("key"), F.col("n").alias("value")).alias("e")).unionByName(
        zone_counts.select(F.lit("zones").alias("part"), F.struct(
            F.col("zone_id").alias("key"), F.col("entry_count").alias("value")).alias("e")))

    def as_map(part: str) -> Column:
        pairs = F.collect_list(F.when(F.col("part") == part, F.col("e")))
        return F.map_from_entries(F.sort_array(pairs)).alias(part)

    return entries.agg(F.struct(as_map("fleet"), as_map("zones")).alias("payload")).select(
        F.lit("snapshot").alias("type"), "payload")


def battery_low(battery: Column) -> Column:
    return battery < DISPLAY_LOW_BATTERY


def fleet_board(state: DataFrame, latest_anomaly: DataFrame) -> DataFrame:
    """Each vehicle with its battery badge and, if any, its newest anomaly."""
    return state.select("vehicle_id", "status", "battery_pct").join(latest_anomaly, "vehicle_id", "left").select(
        "vehicle_id", "status", "battery_pct", battery_low(F.col("battery_pct")).alias("battery_low"),
        "anomaly_type", "detail", "detected_at")

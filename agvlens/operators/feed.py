"""The change feed: what each reading changed, as an ordered table of JSON patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FEED_TYPES, WATCHED_TABLES, SkewPolicy, Thresholds
from ..functions import evaluated_once, iso_utc
from ..schemas import ENVELOPE
from .comms import all_anomalies
from .rules import detect
from .zones import running_counts

# Order of the patches of one reading: its state, its zone, then its anomalies by rule.
SLOT_STATE, SLOT_ZONE, SLOT_ANOMALY = 0, 1, 2


def _json(*fields: Column | str) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def state_payload() -> Column:
    return _json("vehicle_id", "status", "battery_pct")


def anomaly_payload() -> Column:
    return _json("vehicle_id", "anomaly_type", "detail", iso_utc(F.col("detected_at")).alias("detected_at"))


def zone_payload() -> Column:
    return _json("zone_id", "entry_count")


def table_changes(changes: DataFrame) -> DataFrame:
    """Row changes ``(seq, slot, table, row)`` of any table to patches; unwatched tables give none.

    ``row`` is a struct with text members, as a log decoder delivers them.
    """
    col = lambda name: F.col(f"row.{name}")
    payload = (
        F.when(F.col("table") == "vehicle_current_state", _json(
            col("vehicle_id").alias("vehicle_id"), col("status").alias("status"),
            col("battery_pct").try_cast("double").alias("battery_pct")))
        .when(F.col("table") == "anomalies", _json(
            *[col(n).alias(n) for n in ("vehicle_id", "anomaly_type", "detail", "detected_at")]))
        .when(F.col("table") == "zone_counts", _json(
            col("zone_id").alias("zone_id"), col("entry_count").try_cast("bigint").alias("entry_count")))
    )
    kind = F.coalesce(*[F.when(F.col("table") == t, F.lit(e)) for t, e in WATCHED_TABLES.items()])
    return changes.filter(F.col("table").isin(*WATCHED_TABLES)).select(
        "seq", "slot", kind.alias("type"), payload.alias("payload"))


def _patches(df: DataFrame, slot: Column, table: str, payload: Column, ts: Column) -> DataFrame:
    return df.select(
        "seq", slot.cast("int").alias("slot"), F.lit(WATCHED_TABLES[table]).alias("type"),
        payload.alias("payload"), ts.alias("ts"))


def change_feed_of(telemetry: DataFrame, anomalies: DataFrame, zone_base: DataFrame | None = None,
                   policy: SkewPolicy = SkewPolicy(), small: bool = False) -> DataFrame:
    """Patches of ``telemetry`` and of its rows in the anomalies table, silences included.

    ``zone_base`` holds the counters before the first reading. State and zone patches start
    from the plain log, so only the anomalies need the shuffle by vehicle.
    """
    state = _patches(telemetry, F.lit(SLOT_STATE), "vehicle_current_state", state_payload(), F.col("recorded_at"))
    zones = _patches(
        running_counts(telemetry, zone_base, policy, small), F.lit(SLOT_ZONE), "zone_counts", zone_payload(),
        F.col("recorded_at"))
    found = _patches(anomalies, F.lit(SLOT_ANOMALY) + F.col("rule_ord"), "anomalies", anomaly_payload(), F.col("detected_at"))
    return state.unionByName(zones).unionByName(found)


def change_feed(telemetry: DataFrame, thresholds: Thresholds = Thresholds(), policy: SkewPolicy = SkewPolicy(),
                until: Column | None = None) -> DataFrame:
    """Patches of a whole log; with ``until``, also of the silences that sweeps up to then would have flagged."""
    if until is None:
        return change_feed_of(telemetry, detect(telemetry, thresholds=thresholds, policy=policy), policy=policy)
    return change_feed_of(telemetry, all_anomalies(telemetry, until, thresholds=thresholds, policy=policy), policy=policy)


def parse_patches(messages: DataFrame) -> DataFrame:
    """Feed messages (seq, slot, value) to typed patches.

    Text that is not JSON, an unknown type, or a payload that is not an object is dropped;
    transport metadata beside type and payload is left behind. Counters may be written as 3 or 3.0.
    Never fails on input.
    """
    envelope = F.from_json("value", ENVELOPE, {"mode": "PERMISSIVE"})
    decoded = evaluated_once(messages, "m", envelope)
    return decoded.filter(F.col("m.type").isin(*FEED_TYPES) & F.col("m.payload").isNotNull()).select(
        "seq", "slot", "m.type", F.col("m.payload").withField("entry_count", F.col("m.payload.entry_count").try_cast("long")).alias("payload"))

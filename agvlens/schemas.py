"""Schemas of the input and output tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STR, DBL, LNG, INT, TS = (
    T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType(),
)
CODES = T.ArrayType(T.StringType())
LABELS = T.MapType(T.StringType(), T.StringType())

# ``seq`` is the arrival order: unique, and the only order the operators go by.
TELEMETRY = _schema(
    ("seq", LNG), ("vehicle_id", STR), ("status", STR), ("battery_pct", DBL), ("recorded_at", TS),
    ("zone_entered", STR), ("speed_mps", DBL), ("error_codes", CODES), ("pos_x", DBL), ("pos_y", DBL),
)
# What a request body may contain, i.e. telemetry without the arrival order.
TELEMETRY_FIELDS = tuple(f.name for f in TELEMETRY.fields if f.name != "seq")
TELEMETRY_JSON = _schema(("seq", LNG), ("raw", STR), ("ingest_ts", TS))

STATUS_UPDATE = _schema(("seq", LNG), ("vehicle_id", STR), ("status", STR), ("reason", STR))
STATUS_UPDATE_JSON = _schema(("seq", LNG), ("vehicle_id", STR), ("raw", STR))
STATUS_UPDATE_FIELDS = ("status", "reason")

CURRENT_STATE = _schema(
    ("vehicle_id", STR), ("status", STR), ("battery_pct", DBL), ("recorded_at", TS),
    ("speed_mps", DBL), ("pos_x", DBL), ("pos_y", DBL), ("last_seq", LNG),
)
ANOMALIES = _schema(
    ("seq", LNG), ("rule_ord", INT), ("vehicle_id", STR), ("anomaly_type", STR),
    ("detail", STR), ("detected_at", TS),
)
ZONE_COUNTS = _schema(("zone_id", STR), ("entry_count", LNG))
VEHICLES = _schema(("vehicle_id", STR), ("status", STR))
MISSIONS = _schema(("mission_id", LNG), ("vehicle_id", STR), ("status", STR))
MAINTENANCE = _schema(
    ("id", LNG), ("vehicle_id", STR), ("mission_id", LNG), ("reason", STR),
    ("opened_at", TS), ("resolved_at", TS),
)
OUTCOMES = _schema(
    ("seq", LNG), ("vehicle_id", STR), ("status", STR), ("reason", STR), ("prior_status", STR), ("outcome", STR),
)
TRANSITIONS = _schema(("seq", LNG), ("vehicle_id", STR), ("prior_status", STR), ("reason", STR))
OPENED_RECORDS = _schema(("vehicle_id", STR), ("mission_id", LNG), ("reason", STR), ("opened_seq", LNG))
FLEET = _schema(
    ("vehicle_id", STR), ("status", STR), ("known", T.BooleanType()), ("mission_id", LNG), ("faulted", T.BooleanType()), ("opened", T.BooleanType()),
)
SWEPT = _schema(("vehicle_id", STR), ("anomaly_type", STR), ("detail", STR), ("detected_at", TS))
CHANGE_FEED = _schema(("seq", LNG), ("slot", INT), ("type", STR), ("payload", STR), ("ts", TS))
PATCH_PAYLOAD = _schema(
    ("vehicle_id", STR), ("status", STR), ("battery_pct", DBL), ("anomaly_type", STR),
    ("detail", STR), ("detected_at", STR), ("zone_id", STR), ("entry_count", DBL),
)
BOARD = _schema(
    ("key", STR), ("type", STR), ("id", STR), ("status", STR), ("battery_pct", DBL), ("entry_count", LNG),
    ("anomaly_type", STR), ("detail", STR), ("detected_at", STR),
)
ENVELOPE = _schema(("type", STR), ("payload", PATCH_PAYLOAD))
REQUESTS = _schema(
    ("ts", TS), ("method", STR), ("route", STR), ("status_code", INT), ("duration_ms", DBL),
)
METRIC_SAMPLES = _schema(("ts", TS), ("name", STR), ("labels", LABELS), ("le", DBL), ("value", DBL))
SPANS = _schema(
    ("trace_id", LNG), ("span_id", LNG), ("parent_span_id", LNG), ("service", STR), ("name", STR),
    ("kind", STR), ("start_ts", TS), ("duration_ms", DBL), ("attributes", LABELS),
)

"""Names, thresholds and layout limits every operator is parameterised by."""

from __future__ import annotations

from dataclasses import dataclass

# Vehicle statuses, in reporting order.
STATUSES = ("idle", "moving", "charging", "fault")

# The known zones, in seeding order.
ZONES = (
    "inbound_dock_a",
    "inbound_dock_b",
    "receiving_staging",
    "aisle_a",
    "aisle_b",
    "aisle_c",
    "high_bay_1",
    "high_bay_2",
    "bulk_storage",
    "pick_zone_1",
    "pick_zone_2",
    "pack_station",
    "sort_belt",
    "outbound_dock_a",
    "outbound_dock_b",
    "shipping_staging",
    "charging_bay_1",
    "charging_bay_2",
    "charging_bay_3",
    "maintenance_bay",
)

# Change-feed event types, and the table each one reports on.
VEHICLE_STATE_CHANGED = "vehicle_state_changed"
ANOMALY_DETECTED = "anomaly_detected"
ZONE_COUNT_CHANGED = "zone_count_changed"
WATCHED_TABLES = {
    "vehicle_current_state": VEHICLE_STATE_CHANGED,
    "anomalies": ANOMALY_DETECTED,
    "zone_counts": ZONE_COUNT_CHANGED,
}
FEED_TYPES = tuple(WATCHED_TABLES.values())

# Mission statuses.
MISSION_STATUSES = ("active", "cancelled", "completed")

# Upper bounds (ms) of the default OpenTelemetry histogram buckets; +Inf follows.
LATENCY_BOUNDS_MS = (
    0.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 250.0,
    500.0, 750.0, 1000.0, 2500.0, 5000.0, 7500.0, 10000.0,
)

VEHICLE_ID_MAX = 64
BATTERY_RANGE = (0.0, 100.0)
DISPLAY_LOW_BATTERY = 20.0  # the board's "low" badge; the low_battery rule has its own bound


@dataclass(frozen=True)
class Thresholds:
    """Anomaly bounds. All comparisons are strict except ``stuck_seconds``."""

    low_battery_pct: float = 15.0
    overspeed_mps: float = 5.0
    stuck_mps: float = 0.1
    stuck_seconds: float = 10.0
    teleport_mps: float = 15.0
    comms_loss_seconds: int = 5


@dataclass(frozen=True)
class SloBounds:
    """Pass/fail bounds of a load run."""

    p95_ms: float = 750.0
    max_error_rate: float = 0.05
    min_check_rate: float = 0.95
    max_failed_rate: float = 0.05


@dataclass(frozen=True)
class SkewPolicy:
    """When and how far a key's rows are split over several tasks.

    A key with more than about ``hot_rows`` rows is cut into slices of its ordering
    column, wide enough for about ``hot_rows`` of its rows if these are spread evenly.
    Only the layout depends on these numbers, never a result.
    """

    hot_rows: int = 2_000_000
    max_hot_keys: int = 100_000
    sample_hits: int = 64
    salts: int = 128

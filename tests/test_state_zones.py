from conftest import at, rows_of

from agvlens.config import STATUSES, ZONES
from agvlens.operators import state, zones


def test_fleet_counts_every_status(telemetry):
    df = telemetry(dict(vehicle_id="a"), dict(vehicle_id="b"), dict(vehicle_id="c", status="idle"))
    assert dict(rows_of(state.fleet_state(df))) == {"idle": 1, "moving": 2, "charging": 0, "fault": 0}
    assert dict(rows_of(state.fleet_state(df.limit(0)))) == dict.fromkeys(STATUSES, 0)


def test_last_arrival_wins_even_if_older(telemetry):
    df = telemetry(
        *[dict(vehicle_id=f"v-{i}", at=100) for i in range(50)],
        *[dict(vehicle_id=f"v-{i}", status=STATUSES[i % 4], battery_pct=i, at=50) for i in range(50)])
    counts = dict(rows_of(state.fleet_state(df)))
    assert counts == {"idle": 13, "moving": 13, "charging": 12, "fault": 12} and sum(counts.values()) == 50
    current = state.current_state(df)
    assert current.count() == 50
    row = current.filter("vehicle_id = 'v-7'").first()
    assert (row["status"], row["battery_pct"], row["recorded_at"], row["last_seq"]) == (
        "fault", 7.0, at(50).replace(tzinfo=None), 57)
    assert rows_of(state.last_status(df)) == rows_of(current, "vehicle_id", "status")


def test_size_check_and_list_order(telemetry):
    df = telemetry(*[dict(vehicle_id=f"v-{i}") for i in (2, 10, 1, 2)])
    assert tuple(state.fleet_size_check(df).first()) == (3, 3, True)
    listed = state.vehicle_list(state.current_state(df)).collect()
    assert [r["vehicle_id"] for r in listed] == ["v-1", "v-10", "v-2"]  # text order
    assert rows_of(state.events_per_vehicle(df)) == [("v-1", 1), ("v-10", 1), ("v-2", 2)]


def test_late_readings(telemetry):
    df = telemetry(dict(at=0), dict(at=10), dict(at=4), dict(at=4), dict(vehicle_id="b"))
    assert rows_of(state.late_readings(state.with_prior(df))) == [("agv-1", 4, 2, 6.0), ("b", 1, 0, None)]


def test_zone_burst_and_mix(telemetry):
    burst = dict(rows_of(zones.zone_counts(telemetry(*[dict(zone_entered="high_bay_1")] * 50))))
    assert burst == dict.fromkeys(ZONES, 0) | {"high_bay_1": 50}
    mix = telemetry(*[dict(zone_entered=z) for z in ("receiving_staging", "receiving_staging", "pick_zone_2", None, "zone-07")])
    assert dict(rows_of(zones.zone_counts(mix))) == dict.fromkeys(ZONES, 0) | {"receiving_staging": 2, "pick_zone_2": 1}
    assert rows_of(zones.unknown_zone_entries(mix)) == [("zone-07", 1)]


def test_seeding_never_resets(spark):
    existing = spark.createDataFrame([("aisle_a", 7), ("aisle_b", 0)], "zone_id string, entry_count long")
    once = zones.seed_zones(existing)
    assert dict(rows_of(once)) == dict.fromkeys(ZONES, 0) | {"aisle_a": 7}
    assert rows_of(zones.seed_zones(once)) == rows_of(once)


def test_running_counts_continue_from_a_base(spark, telemetry):
    df = telemetry(*[dict(zone_entered=z) for z in ("aisle_a", "aisle_b", None, "aisle_a")])
    base = spark.createDataFrame([("aisle_a", 5)], "zone_id string, entry_count long")
    assert rows_of(zones.running_counts(df, base), "seq", "zone_id", "entry_count") == [
        (0, "aisle_a", 6), (1, "aisle_b", 1), (3, "aisle_a", 7)]

"""The physical plans the operators are meant to get."""

import re

import pytest

from agvlens.operators import faults, rules, state, zones
from agvlens.schemas import MISSIONS, STATUS_UPDATE, VEHICLES
from agvlens.sources import readers


@pytest.fixture
def stored(spark, telemetry, tmp_path):
    path = str(tmp_path / "log")
    telemetry(*[dict(vehicle_id=f"v{i % 5}", at=i, speed_mps=i % 9, zone_entered="aisle_a") for i in range(50)]).write.parquet(path)
    return readers.read_telemetry(spark, path)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text: str) -> int:
    return len(re.findall(r"Exchange (?:hash|range)partitioning|Exchange SinglePartition", text))


def test_one_rule_is_a_pushed_filter_over_its_columns(stored):
    text = plan(rules.detect_one(stored, "overspeed"))
    assert "GreaterThan(speed_mps,5.0)" in text and exchanges(text) == 0
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"seq", "vehicle_id", "speed_mps", "recorded_at"}


def test_all_rules_take_one_shuffle_and_do_not_carry_the_payload_twice(stored):
    text = plan(rules.detect(stored))
    assert exchanges(text) == 1 and "zone_entered" not in text
    assert "struct(" not in text.split("Exchange")[1]


def test_fleet_state_aggregates_by_hash(stored):
    text = plan(state.fleet_state(stored))
    assert "SortAggregate" not in text and "battery_pct" not in text


def test_vehicle_and_time_filters_reach_the_scan(stored):
    wanted = stored.filter("vehicle_id = 'v1' and recorded_at >= '2031-03-09'")
    text = plan(state.current_state(wanted))
    assert "EqualTo(vehicle_id,v1)" in text and "GreaterThanOrEqual(recorded_at" in text


def test_zone_filter_reaches_the_scan(stored):
    text = plan(zones.entries_per_zone(stored))
    assert "In(zone_entered" in text and exchanges(text) == 1


def test_commands_are_shuffled_once_for_window_and_join(spark, tmp_path):
    for name, schema in [("c", STATUS_UPDATE), ("v", VEHICLES)]:
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        commands = spark.read.schema(STATUS_UPDATE).parquet(str(tmp_path / "c"))
        vehicles = spark.read.schema(VEHICLES).parquet(str(tmp_path / "v"))
        assert exchanges(plan(faults.outcomes(commands, vehicles))) == 2  # one per table
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_finished_missions_bypass_the_join(spark):
    missions = spark.createDataFrame([(1, "a", "active")], MISSIONS)
    moves = spark.createDataFrame([("a",)], "vehicle_id string")
    text = plan(faults.missions_after(missions, moves))
    assert re.search(r"Union", text) and text.count("Join") == 1

"""Inputs that must neither fail a batch nor lose rows."""

import json
import math

import pytest
from agvlens.operators import board, feed, metrics, state
from agvlens.operators.validate import parse_readings
from pyspark.sql import functions as F


@pytest.mark.parametrize("stamp", ["1e17", "1e300", "12345678901234567890", "9e15", "-1e12", "\"0000-01-01\""])
def test_instants_out_of_range_reject_one_body(spark, stamp):
    good = '{"vehicle_id":"v1","status":"idle","battery_pct":50,"recorded_at":2014789510}'
    bad = good.replace("2014789510", stamp)
    rows = spark.createDataFrame([(0, good, None), (1, bad, None)], "seq long, raw string, ingest_ts timestamp")
    assert len(parse_readings(rows).collect()) == 2


def test_null_group_and_nan_in_exact_quantiles(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("g", 2.0)], "route string, v double")
    got = {r["route"]: r["quantile"] for r in metrics.exact_quantiles(rows, "v", ["route"], [0.5]).collect()}
    assert got == {None: 2.0, "g": 2.0}
    rows = spark.createDataFrame([(x,) for x in (-5.0, 1.0, 2.0, 3.0, float("nan"))], "v double")
    got = {r["q"]: r["quantile"] for r in metrics.exact_quantiles(rows, "v", [], [0.5, 1.0]).collect()}
    assert got[0.5] == 2.0 and math.isnan(got[1.0])


def test_unknown_status_is_not_an_older_one(telemetry):
    rows = telemetry({"vehicle_id": "a", "status": "idle"}, {"vehicle_id": "a", "status": "parked"}, {"vehicle_id": "b", "status": "parked"})
    assert {r["status"]: r["n"] for r in state.fleet_state(rows).collect()} == {"idle": 0, "moving": 0, "charging": 0, "fault": 0}
    assert {r["vehicle_id"] for r in state.last_status(rows).collect()} == {"a", "b"}


def test_counters_written_as_decimals_and_mistyped_ones(spark):
    snapshot = spark.createDataFrame([("aisle_a", 7)], "zone_id string, entry_count long")
    fold = lambda value: board.fold_zones(snapshot, feed.parse_patches(spark.createDataFrame(
        [(1, 0, '{"type":"zone_count_changed","payload":{"zone_id":"aisle_a","entry_count":%s}}' % value)], "seq long, slot int, value string"))).first()["entry_count"]
    assert (fold("9"), fold("9.0"), fold('"x"'), fold("null")) == (9, 9, 7, 7)


def test_status_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "requests")
    spark.range(10).select((F.col("id") * 100).cast("int").alias("status_code")).write.parquet(path)
    bad = metrics.errors(spark.read.parquet(path))
    assert "LessThan(status_code,200)" in bad._jdf.queryExecution().executedPlan().toString()
    assert bad.count() == 9


@pytest.mark.parametrize("key", ["x", "a.b", "", "it's", "$", "é \U0001f642", "[0]"])
def test_any_unknown_key_is_seen(spark, key):
    bodies = [{"vehicle_id": "v1", "status": "idle", "battery_pct": 50, "recorded_at": 2014789510, **more} for more in ({}, {key: None}, {key: {"a": 1}})]
    rows = spark.createDataFrame([(i, json.dumps(b), None) for i, b in enumerate(bodies)], "seq long, raw string, ingest_ts timestamp")
    got = {r["seq"]: r["reject_reason"] for r in parse_readings(rows).collect()}
    assert got[0] != "unknown_field" and got[1] == got[2] == "unknown_field"

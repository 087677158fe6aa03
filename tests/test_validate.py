import json
from datetime import datetime

import pytest
from conftest import at, rows_of
from pyspark.sql import functions as F

from agvlens.operators import validate
from agvlens.schemas import STATUS_UPDATE_JSON, TELEMETRY_JSON
from agvlens.sources.readers import canonical_names

GOOD = dict(vehicle_id="v-1", status="moving", battery_pct=72.5)


def parse(spark, *bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b), at(i)) for i, b in enumerate(bodies)]
    return validate.parse_readings(spark.createDataFrame(rows, TELEMETRY_JSON))


def without(key):
    return {k: v for k, v in GOOD.items() if k != key}


CASES = [
    (GOOD, None),
    (GOOD | {"status": "flying"}, "status_unknown"),
    (GOOD | {"status": 3}, "status_type"),
    (without("status"), "status_missing"),
    (GOOD | {"battery_pct": 150}, "battery_pct_range"),
    (GOOD | {"battery_pct": -1}, "battery_pct_range"),
    (GOOD | {"battery_pct": 0}, None),
    (GOOD | {"battery_pct": 100}, None),
    (GOOD | {"battery_pct": "55.5"}, None),
    (GOOD | {"battery_pct": "NaN"}, "battery_pct_range"),
    (GOOD | {"battery_pct": "full"}, "battery_pct_type"),
    (GOOD | {"battery_pct": None}, "battery_pct_type"),
    (without("battery_pct"), "battery_pct_missing"),
    (without("vehicle_id"), "vehicle_id_missing"),
    (GOOD | {"vehicle_id": ""}, "vehicle_id_length"),
    (GOOD | {"vehicle_id": "x" * 64}, None),
    (GOOD | {"vehicle_id": "é" * 64}, None),
    (GOOD | {"vehicle_id": "x" * 65}, "vehicle_id_length"),
    (GOOD | {"vehicle_id": 7}, "vehicle_id_type"),
    (GOOD | {"firmware": 1}, "unknown_field"),
    (GOOD | {"timestamp": "2026-01-01T00:00:00Z"}, "unknown_field"),
    (GOOD | {"speed_mps": -0.1}, "speed_mps_range"),
    (GOOD | {"speed_mps": None}, "speed_mps_type"),
    (GOOD | {"error_codes": None}, "error_codes_type"),
    (GOOD | {"error_codes": "E1"}, "error_codes_type"),
    (GOOD | {"error_codes": ["E1", 2]}, "error_codes_type"),
    (GOOD | {"error_codes": ["E1", None]}, "error_codes_type"),
    (GOOD | {"error_codes": []}, None),
    (GOOD | {"zone_entered": None, "pos_x": None}, None),
    (GOOD | {"zone_entered": 4}, "zone_entered_type"),
    (GOOD | {"pos_x": [1]}, "pos_x_type"),
    (GOOD | {"recorded_at": "noon"}, "recorded_at_type"),
    (GOOD | {"recorded_at": "12:00:00"}, "recorded_at_type"),
    (GOOD | {"recorded_at": None}, "recorded_at_type"),
    ("{\"vehicle_id\": \"v-1\"", "malformed_body"),
    ("[1]", "malformed_body"),
    ("", "malformed_body"),
]


def test_first_reason_of_each_body(spark):
    got = dict(rows_of(parse(spark, *[c[0] for c in CASES]), "seq", "reject_reason"))
    wrong = {i: (CASES[i], got[i]) for i in got if got[i] != CASES[i][1]}
    assert len(got) == len(CASES) and not wrong


def test_accepted_and_rejected_split_the_input(spark):
    parsed = parse(spark, *[c[0] for c in CASES])
    bad = sum(c[1] is not None for c in CASES)
    assert validate.accepted(parsed).count() == len(CASES) - bad
    assert validate.rejected(parsed).count() == bad
    assert validate.reject_counts(parsed).agg(F.sum("n")).first()[0] == bad


def test_defaults_only_for_missing_keys(spark):
    row = validate.accepted(parse(spark, GOOD)).first()
    assert row["recorded_at"] == at(0).replace(tzinfo=None)
    assert (row["speed_mps"], row["error_codes"], row["zone_entered"], row["pos_x"]) == (0.0, [], None, None)


def test_instants(spark):
    texts = ["2033-11-05T07:45:10Z", "2033-11-05T05:15:10.125-02:30", "2033-11-05 07:45:10", 2014789510, 2014789510750]
    got = [r[0] for r in parse(spark, *[GOOD | {"recorded_at": x} for x in texts]).orderBy("seq").select("recorded_at").collect()]
    second = datetime(2033, 11, 5, 7, 45, 10)
    assert got == [second, second.replace(microsecond=125_000), second, second, second.replace(microsecond=750_000)]


def test_typed_readings(telemetry):
    df = telemetry(dict(), dict(battery_pct=float("nan")), dict(battery_pct=100.5), dict(vehicle_id=None),
                   dict(status="off"), dict(speed_mps=-1), dict(battery_pct=None))
    assert rows_of(validate.validate_readings(df), "seq", "reject_reason") == [
        (0, None), (1, "battery_pct_range"), (2, "battery_pct_range"), (3, "vehicle_id_missing"),
        (4, "status_unknown"), (5, "speed_mps_range"), (6, "battery_pct_missing")]


@pytest.mark.parametrize("body, reason", [
    ({"status": "fault", "reason": "E1"}, None), ({"status": "idle"}, None), ({"status": "fault", "reason": None}, None),
    ({"status": "off"}, "status_unknown"), ({"reason": "x"}, "status_missing"), ({"status": "idle", "by": 1}, "unknown_field"),
    ({"status": None}, "status_type"), ({"status": "idle", "reason": 4}, "reason_type"), ("no", "malformed_body"),
])
def test_status_updates(spark, body, reason):
    raw = body if isinstance(body, str) else json.dumps(body)
    df = validate.parse_status_updates(spark.createDataFrame([(1, "v-1", raw)], STATUS_UPDATE_JSON))
    assert df.first()["reject_reason"] == reason


def test_foreign_names_only_on_request(spark):
    foreign = spark.range(1).selectExpr("current_timestamp() as timestamp", "1.0 as lat", "2.0 as lon", "id as seq")
    assert canonical_names(foreign).columns == ["recorded_at", "pos_x", "pos_y", "seq"]

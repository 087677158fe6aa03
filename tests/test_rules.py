from dataclasses import replace

import pytest
from conftest import at, rows_of

from agvlens.config import SkewPolicy, Thresholds
from agvlens.operators import anomalies, rules


def fired_types(df, **kw):
    return [r["anomaly_type"] for r in rules.detect(df, **kw).orderBy("seq", "rule_ord").collect()]


STATELESS = [
    (dict(status="fault"), ["fault_status"]),
    (dict(error_codes=["E101"]), ["error_codes"]),
    (dict(error_codes=[]), []),
    (dict(battery_pct=12), ["low_battery"]),
    (dict(battery_pct=12, status="charging"), []),
    (dict(battery_pct=15), []),
    (dict(speed_mps=6), ["overspeed"]),
    (dict(speed_mps=5), []),
    (dict(speed_mps=6, status="idle"), ["overspeed"]),
    (dict(), []),
    (dict(status="fault", battery_pct=12, speed_mps=6, error_codes=["E1"]),
     ["fault_status", "error_codes", "low_battery", "overspeed"]),
    (dict(speed_mps=0.01, pos_x=0.0, pos_y=0.0), []),  # first reading: no stateful rule
]


@pytest.mark.parametrize("reading, expected", STATELESS)
def test_stateless(telemetry, reading, expected):
    assert fired_types(telemetry(reading)) == expected


SLOW = dict(speed_mps=0.05)
HERE, FAR = dict(pos_x=0.0, pos_y=0.0), dict(pos_x=100.0, pos_y=0.0)
STATEFUL = [
    (SLOW, SLOW | {"at": 11}, ["stuck"]),
    (SLOW, SLOW | {"at": 10}, ["stuck"]),  # the one bound that is not strict
    (SLOW, SLOW | {"at": 4}, []),
    (SLOW | {"status": "idle"}, SLOW | {"at": 11}, []),
    (SLOW, dict(speed_mps=0.1, at=11), []),
    (HERE, FAR | {"at": 1}, ["teleport"]),
    (HERE, FAR | {"at": 10}, []),
    (HERE, dict(pos_x=15.0, pos_y=0.0, at=1), []),
    (HERE, FAR | {"at": 0}, []),  # no time passed
    (HERE, FAR | {"at": -5}, []),  # out of order
    (HERE, dict(pos_x=100.0, pos_y=None, at=1), []),
    (dict(battery_pct=40), dict(battery_pct=45, at=1), ["battery_rising"]),
    (dict(battery_pct=40), dict(battery_pct=45, at=1, status="charging"), []),
    (dict(battery_pct=40), dict(battery_pct=45, at=-9), ["battery_rising"]),  # needs no time
    (dict(battery_pct=40), dict(battery_pct=40, at=1), []),
]


@pytest.mark.parametrize("first, second, expected", STATEFUL)
def test_stateful(telemetry, first, second, expected):
    assert fired_types(telemetry(first, second)) == expected


def test_details_and_times(telemetry):
    df = telemetry(
        dict(battery_pct=3e-4, status="idle", speed_mps=0.05, **HERE),
        dict(battery_pct=12, error_codes=["E1", "E2"], speed_mps=5.5, at=2.5, **FAR),
        dict(vehicle_id="b", speed_mps=0.05), dict(vehicle_id="b", speed_mps=0.0625, at=12.25),
    )
    assert rows_of(rules.detect(df), "seq", "anomaly_type", "detail", "detected_at") == sorted([
        (0, "low_battery", "battery_pct=0.0003", at(0).replace(tzinfo=None)),
        (1, "error_codes", "E1,E2", at(2.5).replace(tzinfo=None)),
        (1, "low_battery", "battery_pct=12.0", at(2.5).replace(tzinfo=None)),
        (1, "overspeed", "speed_mps=5.5", at(2.5).replace(tzinfo=None)),
        (1, "teleport", "implied_mps=40.000", at(2.5).replace(tzinfo=None)),
        (1, "battery_rising", "0.0003 -> 12.0", at(2.5).replace(tzinfo=None)),
        (3, "stuck", "speed_mps=0.0625, dt=12.25s", at(12.25).replace(tzinfo=None)),
    ], key=repr)


def test_prior_is_the_previous_arrival_not_the_previous_time(telemetry):
    df = telemetry(dict(battery_pct=50, at=10), dict(battery_pct=40, at=0), dict(battery_pct=45, at=20))
    assert [tuple(r) for r in rules.detect(df).select("seq", "detail").collect()] == [(2, "40.0 -> 45.0")]


def test_thresholds_and_own_rules(telemetry):
    df = telemetry(dict(speed_mps=6), dict(speed_mps=6, battery_pct=50, at=1))
    strict = replace(Thresholds(), overspeed_mps=7.0)
    assert fired_types(df, thresholds=strict) == []
    own = rules.Rule("battery_drop", True, "prior_battery_pct - battery_pct > 20",
                     x="prior_battery_pct - battery_pct", detail="concat('by ', a)")
    assert fired_types(df, rules=(*rules.RULES, own)) == ["overspeed", "overspeed", "battery_drop"]
    assert rules.detect(df, rules=[own]).first()["detail"] == "by 30.0"
    assert rules.detect_one(df, "battery_drop", rules=[own]).first()["detail"] == "by 30.0"


def test_one_rule_equals_its_share_of_all(telemetry):
    df = telemetry(*[dict(vehicle_id=f"v{i % 3}", battery_pct=(i * 37) % 100, at=i, speed_mps=(i % 13) / 2,
                          pos_x=float(i * 31 % 200), pos_y=0.0, status=["moving", "fault", "charging"][i % 3])
                     for i in range(60)])
    everything = rules.detect(df, policy=SkewPolicy(hot_rows=7, sample_hits=7)).cache()
    for rule in rules.RULES:
        alone = rules.detect_one(df, rule.name)
        assert rows_of(alone, "seq", "detail") == rows_of(
            everything.filter(everything.anomaly_type == rule.name), "seq", "detail")


def test_stateless_rules_alone_need_no_shuffle(telemetry):
    df = telemetry(dict())
    plan = rules.detect(df, rules=rules.RULES[:4])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_recent_is_inclusive_ordered_and_filtered(telemetry):
    df = telemetry(*[dict(vehicle_id=v, status="fault", at=s) for v, s in [
        ("agv-1", -10), ("agv-1", 100), ("agv-1", 0), ("agv-1", 50), ("agv-1", 110), ("agv-2", 50)]])
    found = anomalies.recent(rules.detect(df), "agv-1", at(0), at(100)).collect()
    assert [r["detected_at"] for r in found] == [at(s).replace(tzinfo=None) for s in (0, 50, 100)]
    assert anomalies.recent(rules.detect(df), "ghost", at(0), at(100)).count() == 0
    with pytest.raises(ValueError):
        anomalies.recent(df, "", at(0), at(1))
    with pytest.raises(ValueError):
        anomalies.recent(df, "agv-1", "yesterday", at(1))


def test_latest_breaks_ties_by_what_was_written_last(telemetry):
    df = telemetry(dict(status="fault", battery_pct=5, at=3), dict(vehicle_id="b", status="fault", at=9),
                   dict(vehicle_id="b", speed_mps=9, at=1))
    assert rows_of(anomalies.latest_per_vehicle(rules.detect(df)), "vehicle_id", "anomaly_type") == [
        ("agv-1", "low_battery"), ("b", "fault_status")]

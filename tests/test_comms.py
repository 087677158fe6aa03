from conftest import at, rows_of
from pyspark.sql import functions as F

from agvlens.config import SkewPolicy
from agvlens.operators import anomalies, comms, feed, state
from agvlens.schemas import SWEPT


def sweep(spark, readings, known, now):
    return comms.sweep(state.current_state(readings), known, F.lit(at(now)))


def none_yet(spark):
    return spark.createDataFrame([], SWEPT)


def test_strictly_older_than_the_timeout(spark, telemetry):
    df = telemetry(*[dict(vehicle_id=f"v{s}", at=s) for s in (0, 1, 2)])
    found = sweep(spark, df, none_yet(spark), 6)
    assert rows_of(found) == [("v0", "comms_loss", "no event for over 5s", at(6).replace(tzinfo=None))]


def test_once_per_episode_and_again_after_a_newer_reading(spark, telemetry):
    counts, known = [], none_yet(spark)
    first = telemetry(dict(at=0))
    for now, df in [(6, first), (7, first), (8, first), (16, telemetry(dict(at=0), dict(at=10)))]:
        found = sweep(spark, df, known, now).collect()
        counts.append(len(found))
        known = known.unionByName(spark.createDataFrame(found, SWEPT))
    assert counts == [1, 0, 0, 1]


def test_a_regressed_reading_stays_suppressed(spark, telemetry):
    known = spark.createDataFrame([("agv-1", "comms_loss", "x", at(20))], SWEPT)
    assert sweep(spark, telemetry(dict(at=30), dict(at=3)), known, 60).count() == 0
    other = spark.createDataFrame([("agv-1", "overspeed", "x", at(90))], SWEPT)
    assert sweep(spark, telemetry(dict(at=30)), other, 60).count() == 1


def test_empty_fleet(spark, telemetry):
    assert sweep(spark, telemetry(dict()).limit(0), none_yet(spark), 60).count() == 0


def simulated_sweeps(readings, until):
    """One sweep per second over readings that arrive at their time, by plain loops."""
    found, flagged = [], {}
    for now in range(0, until + 1):
        last = {}
        for vehicle, s in sorted(readings, key=lambda r: r[1]):
            if s < now:
                last[vehicle] = s
        for vehicle, s in last.items():
            if s < now - 5 and flagged.get(vehicle, -1) < s:
                flagged[vehicle] = now
                found.append((vehicle, at(now).replace(tzinfo=None)))
    return sorted(found, key=repr)


def test_episodes_equal_a_sweep_every_second(spark, telemetry):
    times = {"a": [0.5, 3, 9.25, 9.5, 30], "b": [0, 5.5, 11.25, 17.5, 17.75], "c": [2]}
    readings = sorted(((v, s) for v, ss in times.items() for s in ss), key=lambda r: r[1])
    df = telemetry(*[dict(vehicle_id=v, at=s) for v, s in readings])
    want = simulated_sweeps(readings, 40)
    for policy in (SkewPolicy(), SkewPolicy(hot_rows=2, sample_hits=2)):
        got = comms.episodes(df, F.lit(at(40)), policy=policy)
        assert rows_of(got, "vehicle_id", "detected_at") == want


def test_dwell_needs_an_unbroken_run(telemetry):
    slow = [dict(vehicle_id="a", speed_mps=0.05, at=s) for s in range(0, 12)]
    broken = [dict(vehicle_id="b", speed_mps=0.05 if s != 6 else 1, at=s) for s in range(0, 14)]
    idle = [dict(vehicle_id="c", speed_mps=0.0, status="idle", at=s) for s in (0, 30)]
    exact = [dict(vehicle_id="d", speed_mps=0.0, at=s) for s in (0, 10)]
    df = telemetry(*slow, *broken, *idle, *exact)
    for policy in (SkewPolicy(), SkewPolicy(hot_rows=5, sample_hits=5)):
        assert rows_of(comms.stuck_dwell(df, policy=policy), "vehicle_id", "readings", "dwell_s") == [
            ("a", 12, 11.0), ("d", 2, 10.0)]


def test_silences_stand_in_the_anomaly_table_and_in_the_feed(telemetry):
    df = telemetry(dict(vehicle_id="a", status="fault", at=0), dict(vehicle_id="b", at=1), dict(vehicle_id="a", at=20))
    until = F.lit(at(30))
    table = comms.all_anomalies(df, until)
    assert rows_of(table, "seq", "rule_ord", "anomaly_type") == [
        (0, 0, "fault_status"), (0, 7, "comms_loss"), (1, 7, "comms_loss"), (2, 7, "comms_loss")]
    newest = {r["vehicle_id"]: (r["anomaly_type"], r["detected_at"]) for r in anomalies.latest_per_vehicle(table).collect()}
    assert newest == {"a": ("comms_loss", at(26).replace(tzinfo=None)), "b": ("comms_loss", at(7).replace(tzinfo=None))}
    patches = feed.change_feed(df, until=until).filter("slot = 9")
    assert rows_of(patches, "seq", "type") == [(i, "anomaly_detected") for i in range(3)]
    assert feed.change_feed(df).filter("slot = 9").count() == 0

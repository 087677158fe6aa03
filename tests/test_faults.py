import random

from conftest import rows_of

from agvlens.config import SkewPolicy
from agvlens.operators import faults
from agvlens.schemas import MISSIONS, STATUS_UPDATE, VEHICLES


def tables(spark, commands, vehicles, missions=(), open_records=()):
    return (
        spark.createDataFrame([(i, *c) for i, c in enumerate(commands)], STATUS_UPDATE),
        spark.createDataFrame(list(vehicles), VEHICLES),
        spark.createDataFrame(list(missions), MISSIONS),
        spark.createDataFrame([(v,) for v in open_records], "vehicle_id string"),
    )


def run(spark, *args, **kw):
    commands, vehicles, missions, open_records = tables(spark, *args)
    resolved = faults.outcomes(commands, vehicles, **kw)
    moves = faults.transitions(resolved)
    return {
        "outcomes": rows_of(resolved, "seq", "outcome"),
        "missions": rows_of(faults.missions_after(missions, moves), "mission_id", "status"),
        "records": rows_of(faults.maintenance_opened(moves, missions, open_records), "vehicle_id", "mission_id", "reason"),
        "vehicles": dict(rows_of(faults.vehicles_after(commands, vehicles))),
    }


def test_fault_acts_once(spark):
    got = run(spark, [("v-1", "fault", "E7"), ("v-1", "fault", "E8")], [("v-1", "moving")], [(9, "v-1", "active")])
    assert got == {"outcomes": [(0, "applied"), (1, "noop")], "missions": [(9, "cancelled")],
                   "records": [("v-1", 9, "E7")], "vehicles": {"v-1": "fault"}}


def test_fault_without_mission(spark):
    got = run(spark, [("v-1", "fault", None)], [("v-1", "idle")], [(9, "v-1", "completed")])
    assert got["records"] == [("v-1", None, None)] and got["missions"] == [(9, "completed")]


def test_other_vehicle_untouched_and_unknown_vehicle(spark):
    got = run(spark, [("v-5", "fault", None), ("ghost", "fault", None), ("ghost", "idle", None)],
              [("v-5", "moving"), ("v-6", "moving")], [(1, "v-5", "active"), (2, "v-6", "active")])
    assert got["missions"] == [(1, "cancelled"), (2, "active")]
    assert got["outcomes"] == [(0, "applied"), (1, "unknown_vehicle"), (2, "unknown_vehicle")]
    assert got["records"] == [("v-5", 1, None)] and got["vehicles"] == {"v-5": "fault", "v-6": "moving"}


def test_already_in_fault_and_repeated_other_status(spark):
    got = run(spark, [("v", "fault", None), ("v", "idle", None), ("v", "idle", None)], [("v", "fault")])
    assert got["outcomes"] == [(0, "noop"), (1, "applied"), (2, "applied")] and got["records"] == []


def test_fault_again_while_the_record_is_open(spark):
    got = run(spark, [("v", "fault", "a"), ("v", "idle", None), ("v", "fault", "b")], [("v", "idle")])
    assert got["outcomes"] == [(0, "applied"), (1, "applied"), (2, "applied")]
    assert got["records"] == [("v", None, "a")]  # still the first one
    got = run(spark, [("v", "fault", "a")], [("v", "idle")], [(3, "v", "active")], ["v"])
    assert got["records"] == [] and got["missions"] == [(3, "cancelled")]


def one_by_one(commands, vehicles, missions, open_records):
    status, missions = dict(vehicles), {m: (v, s) for m, v, s in missions}
    still_open, outcomes, records = set(open_records), [], []
    for seq, (v, new, reason) in enumerate(commands):
        if v not in status:
            outcomes.append((seq, "unknown_vehicle"))
            continue
        if new == "fault" and status[v] == "fault":
            outcomes.append((seq, "noop"))
            continue
        if new == "fault":
            active = [m for m, (mv, s) in missions.items() if mv == v and s == "active"]
            for m in active:
                missions[m] = (v, "cancelled")
            if v not in still_open:
                still_open.add(v)
                records.append((v, active[0] if active else None, reason))
        status[v] = new
        outcomes.append((seq, "applied"))
    return {"outcomes": sorted(outcomes, key=repr), "missions": sorted(((m, s) for m, (_, s) in missions.items()), key=repr),
            "records": sorted(records, key=repr), "vehicles": status}


def test_random_commands_with_and_without_splitting(spark):
    rnd = random.Random(11)
    names = [f"v{i}" for i in range(12)]
    commands = [("v0" if i % 3 == 0 else rnd.choice([*names, "ghost"]), rnd.choice(["fault", "idle", "charging"]), f"E{i}")
                for i in range(250)]
    vehicles = [(v, rnd.choice(["idle", "fault"])) for v in names]
    missions = [(i, v, "active" if i % 2 else "completed") for i, v in enumerate(names)]
    args = (commands, vehicles, missions, ["v3", "v4"])
    want = one_by_one(*args)
    assert run(spark, *args) == want
    assert run(spark, *args, policy=SkewPolicy(hot_rows=15, sample_hits=15, salts=3)) == want


def test_integrity_and_counts(spark):
    missions = spark.createDataFrame([(1, "a", "active"), (2, "a", "active"), (3, "b", "active"), (4, "b", "completed")], MISSIONS)
    records = spark.createDataFrame(
        [("a", None), ("b", None), ("b", None), ("b", 1)], "vehicle_id string, resolved_at int")
    assert rows_of(faults.integrity_violations(missions, records)) == [("one_active_mission", "a", 2), ("one_open_record", "b", 2)]
    assert rows_of(faults.maintenance_counts(records)) == [("a", 1, 1, 0), ("b", 3, 2, 1)]
    assert rows_of(faults.mission_counts(missions)) == [("a", "active", 2), ("b", "active", 1), ("b", "completed", 1)]

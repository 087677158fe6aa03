"""What grows with the fleet or the days of a log in the streaming jobs: calls of Python, and files."""

from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from agvlens.sources.folders import Folder
from agvlens.streaming import store as stores
from agvlens.streaming import vehicles as tracking
from agvlens.streaming.store import BatchStore


class Map(dict):
    getValue, containsKey, updateValue, removeKey = dict.get, dict.__contains__, dict.__setitem__, dict.pop


def test_vehicles_of_a_group_are_handled_at_once():
    timers, maps = [], {"last": Map(), "due": Map()}
    handle = SimpleNamespace(getMapState=lambda name, *schemas: maps[name], registerTimer=timers.append)
    clock = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    tracker = tracking._tracker(
        5_000_000, False, tracking._STATE, tracking._CARRIED, tracking._OUTPUT.split(", "), tracking._TIME_BIT,
        (tracking.READING, tracking.SILENCE, tracking.LATE, tracking.REPEAT))
    tracker.init(handle)

    def batch(seconds, vehicles, ms):
        rows = [dict(vehicle_id=v, seq=int(s * 1000), us=s * 1_000_000, nulls=0, status="idle", battery_pct=1.0, speed_mps=2.0, pos_x=3.0, pos_y=4.0,
                     zone_entered=None, error_codes=[]) for s in reversed(seconds) for v in vehicles]
        return list(tracker.handleInputRows((7,), iter([pd.DataFrame(rows)]), clock(ms)))

    fleet = [None, *[f"v{i}" for i in range(99)]]
    out = batch([100, 103], fleet, 0)
    assert len(out) == 1 and len(out[0]) == 200 and out[0]["has_prior"].sum() == 100
    assert timers == [109_000]  # one for the second in which all are due
    batch([104], fleet[:40], 0)
    assert timers == [109_000, 110_000]
    told, = tracker.handleExpiredTimer((7,), clock(109_001), SimpleNamespace(getExpiryTimeInMs=lambda: 109_000))
    assert sorted(told["vehicle_id"]) == sorted(fleet[40:]) and set(told["silent_us"]) == {109_000_000}  # the others were heard since
    out = batch([105], fleet[40:], 200_000)  # arrives long after: told at once, without a timer
    assert [len(f) for f in out] == [60] and timers == [109_000, 110_000]  # the silence told covers it
    out = batch([106], fleet[:40], 200_000)
    assert [len(f) for f in out] == [40, 40] and set(out[1]["silent_us"]) == {112_000_000} and timers == [109_000, 110_000]
    assert list(tracker.handleExpiredTimer((7,), clock(200_000), SimpleNamespace(getExpiryTimeInMs=lambda: 110_000))) == []
    assert not maps["due"]


def test_files_follow_days_and_rows_not_tasks(spark, tmp_path, monkeypatch):
    store = BatchStore(spark, str(tmp_path / "s"))
    monkeypatch.setattr(stores, "FILE_ROWS", 4000)
    rows = spark.range(0, 9000, 1, 12).cache()
    day = F.date_add(F.lit("2031-01-01").cast("date"), (F.col("id") % 3).cast("int"))
    assert stores.pieces_of(rows.limit(10)) == 1 and stores.pieces_of(rows) == 3
    for n, pieces in enumerate((1, 3)):
        back = store.write(rows, "t", n, day, pieces)
        folder = Folder(f"{store.root}/t/part={n}-{n}")
        files = sum(f.endswith(".parquet") for d in folder.names() if d.startswith("dt=") for f in folder.names(d))
        assert files <= 3 * pieces and back.count() == 9000 and back.agg(F.sum("id")).first()[0] == 9000 * 8999 // 2

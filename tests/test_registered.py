"""Every registered query against its SQL, and the driver contract."""

import math
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(DIR).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v)
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.execute(ORACLES[name])
    expected = canonical([d[0] for d in want.description], want.fetchall())
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["seq", "rule_ord", "vehicle_id", "anomaly_type", "detail", "detected_at"]
    assert df.count() > 0


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert all(re.fullmatch(r"[a-z_0-9]+", n) for n in QUERIES)


def test_control_counts(spark):
    """Row counts both engines agreed on when the input views were fixed."""
    from agvlens.sources.driver_tables import DriverTables

    t = DriverTables(spark, DIR)
    telemetry = t.telemetry()
    assert telemetry.count() == 1000
    assert telemetry.filter("zone_entered is not null").count() == 800
    assert telemetry.filter("zone_entered = 'zone-07'").count() == 40
    assert telemetry.filter("size(error_codes) > 0").count() == 201
    assert telemetry.filter("pos_x is null").count() == 105
    assert t.missions().count() == 1500 and t.missions().filter("status = 'active'").count() == 100
    outcomes = {r[0]: r[1] for r in QUERIES["status_update_outcomes"](spark, DIR).groupBy("outcome").count().collect()}
    assert outcomes == {"unknown_vehicle": 44, "noop": 61, "applied": 602 - 44 - 61}
    assert QUERIES["fault_transitions"](spark, DIR).count() == 126
    assert QUERIES["trace_conjunction"](spark, DIR).count() == 222
    edges = {(r["client"], r["server"]): r["calls"] for r in QUERIES["service_graph_edges"](spark, DIR).collect()}
    assert edges[("browser", "frontend-api")] == 208 and edges[("cdc-consumer", "frontend-api")] == 202

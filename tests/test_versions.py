from collections import Counter

import pytest
from conftest import at, rows_of
from pyspark.sql import functions as F

from agvlens.operators import anomalies, metrics, versions
from agvlens.schemas import ANOMALIES

SCHEMA = "a int, b string, c array<int>"
ROWS = [(1, "x", [1]), (1, "x", [1]), (2, None, None), (None, "", []), (3, "y", [2, 3])]


def net(left, right):
    a, b = Counter(map(repr, left)), Counter(map(repr, right))
    return sorted([("left", n, r) for r, n in (a - b).items()] + [("right", n, r) for r, n in (b - a).items()])


@pytest.mark.parametrize("other", [
    ROWS[::-1], ROWS[:-1], [*ROWS, (1, "x", [1])], [(1, "x", [1]), (2, "", None), (None, None, []), (3, "y", [3, 2]), (1, "x", [1])], [],
])
@pytest.mark.parametrize("buckets", [1, 1024])
def test_multisets_are_compared_whatever_their_order(spark, other, buckets):
    left = spark.createDataFrame(ROWS, SCHEMA)
    right = spark.createDataFrame(other, SCHEMA).select("c", "b", "a").repartition(3)
    want = net(ROWS, other)
    got = sorted((r["only_in"], r["n"], repr((r["a"], r["b"], r["c"]))) for r in versions.difference(left, right, buckets).collect())
    assert got == want
    same = versions.same_rows(left, right, buckets).first()
    assert (same["equal"], same["left_rows"], same["right_rows"]) == (not want, len(ROWS), len(other))


def test_two_empty_versions_are_equal_and_columns_must_agree(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert versions.same_rows(none, none).first()["equal"] and versions.difference(none, none).count() == 0
    with pytest.raises(ValueError):
        versions.differing(none, none.drop("c"))


def test_only_differing_buckets_are_compared(spark):
    left = spark.range(5000).withColumn("x", F.col("id") % 7)
    right = left.withColumn("x", F.when(F.col("id") == 17, 99).otherwise(F.col("x")))
    wrong = versions.differing(left, right)
    assert 1 <= wrong.count() <= 2
    assert rows_of(versions.difference(left, right)) == [("left", 1, 17, 3), ("right", 1, 17, 99)]


def test_parameters_as_a_table(spark):
    rows = [(i, 0, f"v{i % 3}", "stuck", None, at(i * 60)) for i in range(200)] + [(900, 1, None, "stuck", None, at(5))]
    table = spark.createDataFrame(rows, ANOMALIES)
    text = lambda s: at(s).strftime("%Y-%m-%dT%H:%M:%SZ")
    asked = [("all", "v1", "0001-01-01", "9999-12-31"), ("edge", "v0", text(0), text(180)), ("edge", "v2", text(0), text(180)), ("none", "v0", text(180), text(0)),
             ("bad1", "", text(0), text(9)), ("bad2", "v1", "soon", text(9)), ("bad3", None, text(0), text(9)), ("bad4", "v1", text(0), None), ("later", "v1", text(10**6), text(10**7)),
             ("plain", "v1", at(0).strftime("%Y-%m-%d %H:%M:%S"), text(60))]
    parameters = spark.createDataFrame(asked, "query_id string, vehicle_id string, since string, until string")
    got = rows_of(anomalies.recent_for(table, parameters), "query_id", "seq")
    want = [("all", i) for i in range(1, 200, 3)] + [("edge", 0), ("edge", 2), ("edge", 3), ("plain", 1)]
    assert got == sorted(want, key=repr)
    reasons = {r["query_id"]: r["reject_reason"] for r in anomalies.checked_parameters(parameters).select("query_id", "reject_reason").collect()}
    assert {k: v for k, v in reasons.items() if v} == {"bad1": "vehicle_id", "bad2": "since", "bad3": "vehicle_id", "bad4": "until"}
    assert anomalies.recent_for(table.limit(0), parameters).count() == 0
    plan = anomalies.recent_for(table, parameters)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_sketches_of_days_add_up(spark):
    rows = spark.range(20000).selectExpr("timestamp'2031-01-01' + make_interval(0,0,0,cast(id % 9 as int)) as ts", "concat('r', id % 2) as route", "case when id % 50 = 0 then null else pow(id % 1000, 2) end as v")
    sketches = metrics.daily_sketches(rows, "v", ["route"])
    assert sketches.count() == 18
    found = metrics.sketched_quantiles(sketches, ["route"], [0.0, 0.5, 0.95, 1.0])
    errors = metrics.rank_errors(rows, "v", ["route"], found.drop("n"))
    assert errors.count() == 8 and errors.agg(F.max("rank_error")).first()[0] <= metrics.SKETCH_BOUND
    assert {r["n"] for r in errors.collect()} == {r["n"] for r in found.collect()}

import random

import numpy as np
import pytest
from conftest import at, rows_of
from pyspark.sql import functions as F

from agvlens.config import SkewPolicy
from agvlens.operators import metrics, traces
from agvlens.schemas import METRIC_SAMPLES, REQUESTS, SPANS


def requests(spark, *rows):
    return spark.createDataFrame([(at(s), "POST", r, c, float(ms)) for s, r, c, ms in rows], REQUESTS)


def test_counts_rates_and_errors(spark):
    df = requests(spark, (0, "/a", 201, 1), (1, "/a", 404, 1), (3700, "/b", 500, 1), (2, "/a", 200, 1), (3, "/a", 302, 1))
    assert rows_of(metrics.request_counts(df), "route", "status_code", "n") == [
        ("/a", 200, 1), ("/a", 201, 1), ("/a", 302, 1), ("/a", 404, 1), ("/b", 500, 1)]
    assert rows_of(metrics.errors(df), "status_code") == [(302,), (404,), (500,)]
    rates = metrics.rate_per_window(df, ["route"]).orderBy("window_start").collect()
    assert [(r["route"], r["n"], r["rate_per_s"]) for r in rates] == [("/a", 4, 4 / 3600), ("/b", 1, 1 / 3600)]


def test_sliding_windows_cover_each_row_once_per_window(spark):
    df = requests(spark, (0, "/a", 201, 1), (59, "/a", 201, 1), (60, "/a", 201, 1))
    got = metrics.sliding_rate(df, ["route"]).orderBy("window_start").collect()
    assert [(int((r["window_start"] - at(0).replace(tzinfo=None)).total_seconds() // 60), r["n"]) for r in got] == [
        (-3, 2), (-2, 3), (-1, 3), (0, 3), (1, 1)]


def test_histogram_is_cumulative_and_complete(spark):
    df = requests(spark, *[(0, "/a", 201, v) for v in (0, 5, 5.1, 300, 20000)])
    got = metrics.cumulative_buckets(df, "duration_ms", ["route"], (0, 5, 10, 500)).collect()
    assert [(r["le"], r["value"]) for r in got] == [(0, 1), (5, 2), (10, 3), (500, 4), (None, 5)]


@pytest.mark.parametrize("counts, q, want", [
    ([(10, 0), (20, 10), (None, 10)], 0.5, 15.0),
    ([(10, 4), (20, 8), (None, 8)], 0.25, 5.0),
    ([(10, 0), (20, 0), (None, 5)], 0.95, 20.0),  # only +Inf: highest finite bound
    ([(10, 0), (None, 0)], 0.5, None),
    ([(10, 1), (20, 2), (40, 4), (None, 4)], 1.0, 40.0),
])
def test_histogram_quantile(spark, counts, q, want):
    df = spark.createDataFrame([("g", le if le is None else float(le), n) for le, n in counts], "g string, le double, value long")
    assert metrics.histogram_quantile(df, ["g"], q).first()["quantile"] == want


def test_exact_quantiles(spark):
    rnd = random.Random(4)
    values = {"a": [rnd.choice([1.5, 2.5, rnd.uniform(0, 300)]) for _ in range(400)], "b": [7.0], "c": [3.0, 4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    got = {(r["g"], r["q"]): r["quantile"] for r in metrics.exact_quantiles(df, "v", ["g"], [0, 0.5, 0.95, 1]).collect()}
    for (g, q), v in got.items():
        assert v == pytest.approx(np.quantile(values[g], q))
    assert len(got) == 12
    overall = metrics.exact_quantiles(df, "v", [], [0.95]).first()["quantile"]
    assert overall == pytest.approx(np.quantile(sum(values.values(), []), 0.95))
    for unit in (1e-3, 1e6):  # slices follow the data, not their unit
        scaled = df.withColumn("v", F.col("v") * unit)
        for slices in (3, 128):
            found = metrics.exact_quantiles(scaled, "v", ["g"], [0.25, 0.95], slices=slices).collect()
            assert all(r["quantile"] == pytest.approx(np.quantile(values[r["g"]], r["q"]) * unit) for r in found) and len(found) == 6
    sketch = metrics.approx_quantiles(df, "v", ["g"], [0.5]).filter("g = 'b'").first()["quantile"]
    assert sketch == 7.0


def samples(spark, *rows):
    df = spark.createDataFrame([(at(s), "n", {"route": r}, None, float(v)) for s, r, v in rows], METRIC_SAMPLES)
    return df.withColumn("route", F.col("labels")["route"])


def test_counter_restart(spark):
    df = samples(spark, (0, "a", 5), (10, "a", 9), (20, "a", 2), (30, "a", 2), (0, "b", 100))
    got = rows_of(metrics.counter_increases(df, ["route"]), "increase", "rate_per_s")
    assert got == [(0.0, 0.0), (2.0, 0.2), (4.0, 0.4)]
    assert rows_of(metrics.counter_increases(df, ["route"], SkewPolicy(hot_rows=1, sample_hits=1)), "increase", "rate_per_s") == got
    assert rows_of(metrics.counter_rate(df, ["route"]), "route", "increase") == [("a", 6.0)]


def test_gauges(spark):
    df = samples(spark, (0, "a", 5), (10, "a", 3), (0, "b", 4), (10, "c", 1), (20, "c", 9))
    assert metrics.gauge_max(df, [], ["route"]).first()["value"] == 9.0
    assert rows_of(metrics.gauge_max(df, ["route"], []), "route", "value") == [("a", 3.0), ("b", 4.0), ("c", 9.0)]
    drops = dict(rows_of(metrics.gauge_drop_rate(df, ["route"]), "route", "drop_per_s"))
    assert drops["a"] == pytest.approx(0.2) and drops["b"] is None and drops["c"] == 0.0


def test_lag(spark):
    df = spark.createDataFrame([("walreceiver", 4096), ("other", 0), ("", 8192), ("absent", None), (None, 7)],
                               "application_name string, lag_bytes long")
    assert rows_of(metrics.lag_by_source(df)) == [("other", 0), ("standby", 7), ("standby", 8192), ("walreceiver", 4096)]
    times = spark.createDataFrame([(1, at(0), at(12.5)), (2, at(0.4), at(0)), (3, None, at(0))], "i int, r timestamp, now timestamp")
    got = rows_of(times.select("i", metrics.freshness_seconds(F.col("now"), F.col("r")).alias("s")))
    assert got == [(1, 12.5), (2, 0.0), (3, None)]


def test_slo(spark):
    good = requests(spark, *[(i, "/a", 201, i) for i in range(100)]).cache()
    row = metrics.slo_report(good).first()
    assert row["passed"] and row["p95_ms"] == pytest.approx(94.05) and row["requests"] == 100
    slow = requests(spark, *[(i, "/a", 201, 760) for i in range(10)])
    assert not metrics.slo_report(slow).first()["passed"]
    failing = requests(spark, *[(i, "/a", 500 if i < 5 else 201, 1) for i in range(100)])
    row = metrics.slo_report(failing).first()
    assert (row["error_rate"], row["check_rate"], row["failed_rate"], row["passed"]) == (0.05, 0.95, 0.05, False)


def test_route_falls_back_to_the_path(spark):
    df = spark.createDataFrame([("/v/{id}", "/v/1"), (None, "/nope")], "route string, path string")
    assert rows_of(df.select(metrics.route_or_path().alias("r"))) == [("/nope",), ("/v/{id}",)]


def spans(spark, *rows):
    return spark.createDataFrame(
        [(t, i, p, s, n, k, at(i), float(ms), a) for t, i, p, s, n, k, ms, a in rows], SPANS)


def test_traces(spark):
    df = spans(
        spark,
        (1, 10, None, "web", "load", "CLIENT", 50, {}), (1, 11, 10, "api", "GET", "SERVER", 30, {"m": "GET"}),
        (1, 12, 11, "api", "db", "CLIENT", 5, {"server.address": "db"}), (2, 20, None, "cdc", "publish", "PRODUCER", 2, {}),
        (2, 21, 20, "api", "subscribe", "CONSUMER", 4, {}), (3, 30, None, "web", "load", "CLIENT", 9, {}))
    edges = rows_of(traces.service_graph(df), "client", "server", "instrumented", "calls", "avg_ms")
    assert edges == [("api", "db", False, 1, 5.0), ("cdc", "api", True, 1, 4.0), ("web", "api", True, 1, 30.0)]
    assert rows_of(traces.traces_with_all(df, "web", "api")) == [(1,)]
    assert [r["trace_id"] for r in traces.recent_traces(df, "api", 1).collect()] == [2]
    assert rows_of(traces.span_search(df, "api", "GET", {"m": "GET"}), "span_id") == [(11,)]
    assert traces.span_search(df, "api", "GET", {"m": "PUT"}).count() == 0


def test_quantiles_of_what_bucket_counters_gained(spark):
    df = requests(spark, (0, "/a", 201, 1), *[(60, "/a", 201, v) for v in (2, 4, 7, 8)], (86_400, "/a", 201, 20), (86_460, "/a", 201, 9))
    samples = metrics.bucket_samples(df, "duration_ms", ["route"], (5, 10))
    got = metrics.windowed_histogram_quantiles(samples, ["route"], [0.5, 0.75])
    assert [v for *_, v in sorted(tuple(r) for r in got.select("window_start", "q", "quantile").collect())] == [5.0, 7.5, 10.0, 10.0]

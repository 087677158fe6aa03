import random
import re

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from agvlens.config import SkewPolicy
from agvlens.operators import skew, state, zones
from agvlens.operators.rules import detect

TINY = SkewPolicy(hot_rows=20, sample_hits=20, salts=4)


@pytest.fixture(scope="module")
def log(spark):
    """One key holds a third of all rows, one has a single row, some have a few."""
    rnd = random.Random(3)
    rows = []
    for seq in rnd.sample(range(5000), 900):
        key = "hot" if seq % 3 == 0 else f"k{rnd.randint(0, 60)}"
        rows.append((seq, key, rnd.randint(0, 9)))
    rows.append((77777, "once", 1))
    return spark.createDataFrame(rows, "seq long, key string, x int").repartition(4).cache()


def reference_neighbours(rows, step):
    by_key = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        by_key.setdefault(r["key"], []).append(r)
    out = []
    for items in by_key.values():
        for i, r in enumerate(items):
            j = i + step
            other = items[j]["x"] if 0 <= j < len(items) else None
            out.append((r["seq"], other))
    return sorted(out, key=repr)


@pytest.mark.parametrize("following", [False, True])
@pytest.mark.parametrize("mode", ["cold", "hot", "everything"])
def test_neighbour(log, mode, following):
    hot = {"cold": skew.no_hot_keys("key"), "hot": skew.find_hot_keys(log, "key", policy=TINY),
           "everything": skew.every_key("key")}[mode]
    got = skew.with_neighbour(log, hot, ["seq"], ["x"], "n", following=following, policy=TINY)
    assert rows_of(got, "seq", "n_x") == reference_neighbours(log.collect(), 1 if following else -1)
    assert got.columns == ["seq", "key", "x", "n_x", "n_seq"]


@pytest.mark.parametrize("mode", ["cold", "hot", "everything"])
def test_running_sum(log, mode):
    hot = {"cold": skew.no_hot_keys("key"), "hot": skew.find_hot_keys(log, "key", policy=TINY),
           "everything": skew.every_key("key")}[mode]
    got = skew.with_running_sum(log, hot, ["seq"], F.col("x"), "s", policy=TINY)
    sums, want = {}, []
    for r in sorted(log.collect(), key=lambda r: r["seq"]):
        sums[r["key"]] = sums.get(r["key"], 0) + r["x"]
        want.append((r["seq"], sums[r["key"]]))
    assert rows_of(got, "seq", "s") == sorted(want, key=repr)


def test_only_large_keys_are_hot(log):
    found = skew.find_hot_keys(log, "key", policy=TINY)
    keys = {r["key"] for r in found.table.collect()}
    assert "hot" in keys and "once" not in keys
    assert not skew.find_hot_keys(log, "key", policy=SkewPolicy(hot_rows=10_000))


def test_a_hot_key_is_spread_and_its_slices_are_bounded(log):
    n = log.filter("key = 'hot'").count()
    for apart in (1, 1 << 16):  # a dense log, and positions as a partitioned queue numbers them
        sparse = log.withColumn("seq", F.col("seq") * apart)
        hot = skew.find_hot_keys(sparse, "key", policy=TINY)
        sizes = skew.sliced(sparse, hot, F.col("seq"), TINY.hot_rows).filter("key = 'hot'").groupBy(skew.SLICE).count()
        assert n / TINY.hot_rows <= sizes.count() <= n / TINY.hot_rows + 2
        assert sizes.agg(F.max("count")).first()[0] <= 2 * TINY.hot_rows


def test_null_keys_and_negative_positions_are_split_too(log):
    odd = log.select((F.col("seq") - 2500).alias("seq"), F.when(F.col("key") != "hot", F.col("key")).alias("key"), "x")
    hot = skew.find_hot_keys(odd, "key", policy=TINY)
    assert skew.sliced(odd, hot, F.col("seq"), TINY.hot_rows).filter("key is null").select(skew.SLICE).distinct().count() > 10
    for split in (hot, skew.every_key("key")):
        for got, want in ((skew.with_neighbour(odd, split, ["seq"], ["x"], "n", policy=TINY), skew.with_neighbour(odd, skew.no_hot_keys("key"), ["seq"], ["x"], "n")),
                          (skew.with_running_sum(odd, split, ["seq"], F.col("x"), "s", policy=TINY), skew.with_running_sum(odd, skew.no_hot_keys("key"), ["seq"], F.col("x"), "s"))):
            assert rows_of(got) == rows_of(want)


def test_no_key_is_left_out_where_more_are_large_than_may_be_hot(log):
    few = SkewPolicy(hot_rows=5, sample_hits=5, max_hot_keys=10)
    found = {r["key"] for r in skew.find_hot_keys(log, "key", policy=few).table.collect()}
    total = log.count()
    assert found == {r["key"] for r in log.groupBy("key").count().collect() if r["count"] > total / 10}


def test_rows_are_shuffled_once_and_totals_combined_before(log):
    hot = skew.find_hot_keys(log, "key", policy=TINY)
    plan = skew.with_running_sum(log, hot, ["seq"], F.col("x"), "s", policy=TINY)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
    assert "partial_sum" in plan and "SortMergeJoin" not in plan


def test_hot_slices_survive_a_partitioning_by_the_key_alone(log):
    hot = skew.find_hot_keys(log, "key", policy=TINY)
    together = log.repartition(4, "key")
    got = skew.with_neighbour(together, hot, ["seq"], ["x"], "n", policy=TINY)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(key#\d+, _slice#\d+L", plan)
    assert rows_of(got, "seq", "n_x") == reference_neighbours(log.collect(), -1)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_dimension_join(spark, log, how):
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("unused", 3)], "key string, d int")
    hot = skew.find_hot_keys(log, "key", policy=TINY)
    got = skew.join_dimension(log, dim, hot, "seq", how, TINY)
    assert rows_of(got, "seq", "d") == rows_of(log.join(dim, "key", how), "seq", "d")


def test_operators_do_not_depend_on_the_split(telemetry):
    rnd = random.Random(9)
    df = telemetry(*[
        dict(vehicle_id="hot" if i % 3 == 0 else f"v{i % 7}", at=rnd.randint(0, 500), battery_pct=rnd.randint(0, 100),
             speed_mps=rnd.choice([0.05, 1, 6]), pos_x=float(rnd.randint(0, 500)), pos_y=0.0,
             zone_entered=rnd.choice(["aisle_a", "aisle_a", "aisle_b", None, "nowhere"]))
        for i in range(400)]).cache()
    assert rows_of(detect(df, policy=TINY)) == rows_of(detect(df))
    assert rows_of(zones.running_counts(df, policy=TINY)) == rows_of(zones.running_counts(df))
    shuffled = df.repartition(7, "battery_pct")
    assert rows_of(state.current_state(shuffled)) == rows_of(state.current_state(df))


def test_slices_of_every_key_are_of_equal_depth(spark):
    """Sequence numbers as a Kafka reader makes them, one zone sparse, one in bursts, one tiny."""
    rows = [(i * 65536 + i % 8, "sparse") for i in range(3000)]
    rows += [(10**9 + (i % 100) + (i // 100) * 10**7, "bursts") for i in range(6000)]
    rows += [(5, "tiny"), (6, None)]
    log = spark.createDataFrame(rows, "seq long, key string")
    cut = skew.sliced(log, skew.every_key("key"), F.col("seq"), 50)
    depth = {(r["key"], r[skew.SLICE]): r["count"] for r in cut.groupBy("key", skew.SLICE).count().collect()}
    for key, n in (("sparse", 3000), ("bursts", 6000)):
        mine = [d for (k, _), d in depth.items() if k == key]
        assert n / 50 <= len(mine) <= 4 * n / 50 and max(mine) <= 2 * 100
    assert depth["tiny", 0] == depth[None, 0] == 1 and sum(depth.values()) == 9002
    starts = {k: sorted((r[skew.SLICE], r["lo"], r["hi"]) for r in cut.filter(F.col("key") == k).groupBy(skew.SLICE).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).collect()) for k in ("sparse", "bursts")}
    for cells in starts.values():  # slices follow each other
        assert all(a[2] < b[1] for a, b in zip(cells, cells[1:]))


@pytest.mark.parametrize("mode", ["hot", "everything"])
def test_running_sum_of_kafka_positions(spark, mode):
    rnd = random.Random(9)
    rows = [(s * 65536 + s % 3, rnd.choice(["a", "a", "b", None]), rnd.randint(0, 9)) for s in rnd.sample(range(10**6), 700)]
    log = spark.createDataFrame(rows, "seq long, key string, x int")
    hot = skew.every_key("key") if mode == "everything" else skew.find_hot_keys(log, "key", policy=TINY)
    sums, want = {}, []
    for seq, key, x in sorted(rows, key=lambda r: r[0]):
        sums[key] = sums.get(key, 0) + x
        want.append((seq, sums[key]))
    assert rows_of(skew.with_running_sum(log, hot, ["seq"], F.col("x"), "s", policy=TINY), "seq", "s") == sorted(want, key=repr)

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from agvlens.functions import fixed3_text_sql, float_text


def _texts(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return [r[0] for r in df.select(float_text("x")).collect()]


def test_shortest_decimal_text_in_every_range(spark):
    values = [0.0, -0.0, 12.0, 0.1, 1e-3, 9.5e-4, 1e-4, -1.25e-4, 9.9e-5, 1e-5, 1.5e-10, 1e7, 12345678.0, 12345678.5,
              1e15, 123456789012345.6, 1e16, 1.5e16, 1e22, 1e100, -2.5e-7, 100.0, 0.0625]
    assert _texts(spark, values) == [repr(v) for v in values]


def test_random_battery_like_values(spark):
    rnd = random.Random(5)
    values = [round(rnd.uniform(0, 100), rnd.randint(0, 6)) for _ in range(500)]
    values += [round(rnd.uniform(0, 1e-3), 9) for _ in range(200)]
    assert _texts(spark, values) == [repr(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.decimals(min_value=0, max_value=10**9, places=3), min_size=40, max_size=40))
def test_decimal_inputs(spark, values):
    floats = [float(v) for v in values]
    assert _texts(spark, floats) == [repr(v) for v in floats]


def test_three_decimals_round_the_binary_value(spark):
    values = [1.0005, 0.0625, 15.0005, 1234567.8914, 2.5, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.selectExpr(fixed3_text_sql("x")).collect()] == [f"{v:.3f}" for v in values]

"""The registered corpus queries against their SQL."""

import __spark_entry__ as entry_points
import duckdb
import pytest
from agvlens.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(f'\"{c}\"' for c in columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 1 + len(QUERIES)))

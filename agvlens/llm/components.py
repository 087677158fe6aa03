"""Connected components by alternating star contraction, on edges that stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_EDGE = ["u", "v"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: every node's larger (or smaller) neighbours are linked to its smallest neighbour.

    Only minima are gathered per node, so a node with very many neighbours costs no more than its edges.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least.hint("merge"), "u")  # both sides grow with the graph
    if large:
        return linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node reachable."""
    now = written(edges.select(*_EDGE).filter("u <> v").select(F.greatest(*_EDGE).alias("u"), F.least(*_EDGE).alias("v")).distinct(), "stars")
    tally = None
    while True:
        grown = _star(_star(now, True).filter("u <> v").distinct(), False).filter("u <> v").distinct()
        now = written(grown, "stars")
        # no further change is possible once edges are as before: same number, same sum of hashes
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == tally:
            break
        tally = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))

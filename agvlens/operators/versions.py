"""Whether two versions of a table hold the same rows, and which rows they do not share; order and layout play no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
_LOW = 0xFFFFFFFF
_SUMS = ["n", *[f"s{i}" for i in range(4)]]


def _hashes(df: DataFrame) -> list[Column]:
    """Two hashes of a row, columns by name; a null differs from any value."""
    parts = [F.struct(F.col(f"`{c}`").isNull().alias("n"), F.col(f"`{c}`").alias("v")) for c in sorted(df.columns)]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def digests(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Count and sums of two row hashes per bucket of rows: equal for equal multisets, additive over parts of a table.

    The hashes are added by halves, so that no sum overflows. One aggregate that combines before its only shuffle, of at most
    ``buckets`` rows a task.
    """
    a, b = _hashes(df)
    halves = [h for x in ("a", "b") for h in (F.col(x).bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 32))]
    rows = df.select(a.alias("a"), b.alias("b"))
    return rows.groupBy(F.pmod("a", F.lit(buckets)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(f"s{i}") for i, h in enumerate(halves)])


def _minus(df: DataFrame) -> DataFrame:
    return df.select("bucket", *[(-F.col(c)).alias(c) for c in _SUMS])


def differing(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Buckets in which the two do not hold the same rows; one pass over each side."""
    _same_columns(left, right)
    net = digests(left, buckets).unionByName(_minus(digests(right.select(*left.columns), buckets)))
    summed = net.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in _SUMS])
    return summed.filter(" or ".join(f"{c} <> 0" for c in _SUMS)).select("bucket")


def same_rows(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``equal``, ``left_rows``, ``right_rows``, and how many buckets differ."""
    _same_columns(left, right)
    nothing = [F.lit(0).cast("long").alias(c) for c in ("l", "r")]
    parts = digests(left, buckets).select("*", F.col("n").alias("l"), nothing[1]).unionByName(
        _minus(digests(right.select(*left.columns), buckets)).select("*", nothing[0], (-F.col("n")).alias("r")))
    summed = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in (*_SUMS, "l", "r")])
    wrong = F.count_if(F.expr(" or ".join(f"{c} <> 0" for c in _SUMS)))
    rows = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return summed.agg((wrong == 0).alias("equal"), rows("l").alias("left_rows"), rows("r").alias("right_rows"), wrong.cast("long").alias("buckets_differing"))


def difference(left: DataFrame, right: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows that one side holds ``n`` times more than the other (``only_in``: left or right).

    Only rows of buckets that differ are compared, so two versions that differ little cost two passes and a small shuffle.
    """
    wrong = differing(left, right, buckets)  # at most ``buckets`` numbers
    columns = left.columns
    a, _ = _hashes(left)
    marked = left.withColumn("_sign", F.lit(1)).unionByName(right.select(*columns).withColumn("_sign", F.lit(-1)))
    rows = marked.withColumn("bucket", F.pmod(a, F.lit(buckets))).join(F.broadcast(wrong), "bucket", "left_semi")
    net = rows.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.sum("_sign").alias("_net")).filter("_net <> 0")
    return net.select(F.when(F.col("_net") > 0, "left").otherwise("right").alias("only_in"), F.abs("_net").alias("n"), *[F.col(f"`{c}`") for c in columns])


def _same_columns(left: DataFrame, right: DataFrame) -> None:
    kinds = [sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields) for df in (left, right)]
    if kinds[0] != kinds[1]:
        raise ValueError(f"columns differ: {sorted(set(kinds[0]) ^ set(kinds[1]))}")

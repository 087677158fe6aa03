"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

NO_SITE = "\u0000"  # stands for a null grouping value, which is a group of its own
ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a Parquet table in the folder all executors share: cuts lineage and survives lost executors."""
    folder = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def group_key(*columns: str) -> Column:
    """One text key of several columns; null is a value like any other."""
    return F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit(NO_SITE)) for c in columns])


def row_digest(columns: list[str], salt: int = 0) -> Column:
    """Equal for rows that agree in all ``columns``, nulls included; another ``salt`` gives a digest of its own."""
    parts = [F.struct(F.col(f"`{c}`").isNull().alias("n"), F.col(f"`{c}`").alias("v")) for c in columns]
    return F.xxhash64(*([F.lit(salt)] if salt else []), *parts)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one, so that no name of theirs meets a working column's; ``doc.*`` restores them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")


def per_batch(df: DataFrame, schema: str, work: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``work`` over each Arrow batch of ``df``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield work(batch)

    return df.mapInPandas(run, schema)


def bit_map(df: DataFrame, key: Column, bits: int) -> bytes:
    """A map of 2^``bits`` bits, those set that a 64-bit ``key`` of some row begins with. The driver gets its words, a fixed number at most."""
    bit = F.shiftrightunsigned("k", 64 - bits)
    words = df.select(key.alias("k")).select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(k, {64 - bits}) & 63))").alias("b"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r["w"]] = r["b"]
    return out.tobytes()


def maybe_in(key: Column, shared, bits: int) -> Column:
    """Whether a key may be one of those of a broadcast :func:`bit_map`: no is certain, yes is not."""
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = np.frombuffer(shared.value, np.uint64)
        for k in batches:
            bit = k.to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            yield pd.Series((words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0)

    return F.pandas_udf(look, "boolean")(key)

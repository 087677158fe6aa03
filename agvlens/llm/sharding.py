"""Histogram sort into shards of near equal bytes.

Rows are ordered by (key, content, number of the row). Each round counts, over all partitions, the exact bytes below every candidate
boundary; the candidates around a wanted splitter close in on it until the bytes below are within the tolerance, or the
candidates are neighbours. Then the whole rows are exchanged once, into fine buckets that each belong to one shard, and numbered
there in order; sizes and checksums are taken from the rows as they arrive.

A row's place among those of its key is 32 bits of its content's hash and 32 of its own number's, so equal texts stand together and
a splitter can fall between copies: a key or a text of any weight is split. A bucket is sorted by Spark, which spills, so it may hold any number of rows.

Defined cases: a null key sorts first; a null text is empty (size 8, checksum 0); repeated rows get slots of their own; a very long text
makes its shard larger by at most itself; an empty table gives an empty table; other columns travel along, those named like a result give way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_row, written

SHARDS = 24
PROBES = 16  # candidates per open splitter and round
TOLERANCE = 0.001  # of a shard's bytes
BUCKET_BYTES = 1 << 26  # about what a bucket should hold; only layout depends on it
LAW = "bytes"
_LOW = -(1 << 63)
RESULT = ("size", "text_crc32", "law", "shard", "slot")


def placed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole rows (``doc``) with what they are ordered by (k, tie) and their size; written once, so that places stay."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    tie = F.xxhash64(t).bitwiseAND(F.lit(-1 << 32)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 32) - 1)))
    return written(docs.select(
        whole_row(docs), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LOW)).alias("k"), tie.alias("tie"),
        (F.octet_length(t) + 8).cast("long").alias("size")), "shard-rows")


def _rank(keys: np.ndarray, ties: np.ndarray, probes: list[tuple[int, int]]) -> np.ndarray:
    """For each (key, tie), the number of probes at or below it."""
    if not probes:
        return np.zeros(len(keys), np.int64)
    pk, pt = (np.array(x, np.int64) for x in zip(*probes, strict=True))
    side = np.searchsorted(pk, keys, "left")
    end = np.searchsorted(pk, keys, "right")
    out = side.copy()
    for i in np.flatnonzero(end > side):  # probes with the very same key: compare ties
        out[i] += np.searchsorted(pt[side[i]:end[i]], ties[i], "right")
    return out


def bytes_below(rows: DataFrame, probes: list[tuple[int, int]]) -> list[int]:
    """Exact bytes of the rows below each probe (probes sorted). One number per probe reaches the driver."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            np.add.at(total, _rank(b["k"].to_numpy(), b["tie"].to_numpy(), probes), b["size"].to_numpy())
        at = np.flatnonzero(total)
        yield pd.DataFrame({"p": at, "b": total[at]})

    got = {r["p"]: r["b"] for r in rows.select("k", "tie", "size").mapInPandas(count, "p long, b long").groupBy("p").agg(F.sum("b").alias("b")).collect()}
    return np.cumsum([got.get(i, 0) for i in range(len(probes))]).tolist()


def _between(low: tuple[int, int], high: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """Up to ``n`` pairs strictly between two pairs: spread over keys, or over ties once the keys are neighbours."""
    (a, s), (b, t) = low, high
    if b - a > 1:
        return [(k, _LOW) for k in sorted({a + (b - a) * i // (n + 1) for i in range(1, n + 1)} - {a, b})]
    if b - a == 1 and t != _LOW:
        return [(b, _LOW)]
    end = t if b == a else 1 << 63
    return [(a, x) for x in sorted({s + (end - s) * i // (n + 1) for i in range(1, n + 1)} - {s, end})]


def splitters(rows: DataFrame, wanted: list[int], tolerance: float, probes: int = PROBES) -> list[tuple[int, int, int]]:
    """(key, tie, bytes below it) for each wanted number of bytes."""
    edge = rows.agg(F.min("k"), F.max("k"), F.sum("size")).first()
    low = [((edge[0], _LOW), 0)] * len(wanted)
    high = [((edge[1], (1 << 63) - 1), edge[2])] * len(wanted)
    done: dict[int, tuple[int, int, int]] = {}
    while len(done) < len(wanted):
        asked = {i: _between(low[i][0], high[i][0], probes) for i in range(len(wanted)) if i not in done}
        tried = sorted({p for x in asked.values() for p in x})
        below = dict(zip(tried, bytes_below(rows, tried), strict=True)) if tried else {}
        for i, own in asked.items():
            for p in own:
                if below[p] <= wanted[i]:
                    low[i] = (p, below[p])
                else:
                    high[i] = (p, below[p])
                    break
            ends = [x for x in (low[i], high[i]) if abs(x[1] - wanted[i]) <= tolerance]
            if ends or not own:
                (k, t), b = min(ends, key=lambda x: abs(x[1] - wanted[i])) if ends else low[i]
                done[i] = (k, t, b)
    return [done[i] for i in range(len(wanted))]


def sharded(docs: DataFrame, n_shards: int = SHARDS, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE,
            bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The whole rows of ``docs`` with RESULT: their size, checksum, shard and place in it."""
    rows = placed(docs, key, text)
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = max(1, math.ceil(total / bucket_bytes / n_shards))  # buckets per shard
    buckets = n_shards * parts
    wanted = [total * i // buckets for i in range(1, buckets)] if total else []
    bounds = [(k, t) for k, t, _ in splitters(rows, wanted, tolerance * total / n_shards)] if wanted else []

    def bucket(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for k, tie in batches:
            yield pd.Series(_rank(k.to_numpy(), tie.to_numpy(), bounds).astype(np.int32))

    marked = rows.withColumn("bucket", F.pandas_udf(bucket, "int")("k", "tie"))
    held = {r["bucket"]: r["n"] for r in marked.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number per bucket
    base, upto = [], 0
    for i in range(buckets):
        upto = 0 if i % parts == 0 else upto
        base.append(upto)
        upto += held.get(i, 0)
    ahead = F.get(F.array(*[F.lit(n).cast("long") for n in base]), F.col("bucket"))
    order = Window.partitionBy("bucket").orderBy("k", "tie")
    numbered = marked.withColumn("nth", F.row_number().over(order))
    t = F.coalesce(F.col(f"doc.`{text}`"), F.lit(""))
    own = {
        "size": (F.octet_length(t) + 8).cast("long"), "text_crc32": F.crc32(t), "law": F.lit(LAW),
        "shard": F.floor(F.col("bucket") / parts).cast("int"), "slot": ahead + F.col("nth") - 1}
    return numbered.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in own], *[v.alias(c) for c, v in own.items()])


def shards(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """key and RESULT of every row, without its other columns."""
    return sharded(docs, key=key, **options).select(key, *RESULT)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The shards as files, one folder each; rows keep their slots."""
    sharded(docs, **options).write.partitionBy("shard").parquet(path)

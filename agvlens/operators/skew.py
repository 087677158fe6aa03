"""Ordered per-key operators that stay balanced when one key owns a large share of the rows.

A plain ``lag(...) over (partition by key order by seq)`` sends all rows of a key to one
task. Here the rows of a hot key are cut into slices of the ordering column; each slice is
processed on its own, led by one row that carries what it needs from the slices before.
Cold keys keep the single-shuffle plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..config import SkewPolicy

SLICE = "_slice"
_COLD = -(1 << 63)  # the slice of keys that are not split
_SEED, _WIDTH = "_seed", "_width"
CELLS = 64  # cells of equal depth that a key's positions are cut into before they are cut evenly


@dataclass(frozen=True)
class HotKeys:
    """The keys to split. ``table`` is None if there are none; ``everything`` splits all keys."""

    key: tuple[str, ...]
    table: DataFrame | None = None
    everything: bool = False

    def __bool__(self) -> bool:
        return self.everything or self.table is not None

    def mark(self, df: DataFrame, name: str, value: Column | None = None) -> DataFrame:
        """``df`` with a column that holds ``value`` (over the table; default: true) for hot rows and null for others."""
        value = F.lit(True) if value is None else value
        if self.everything or self.table is None:
            return df.withColumn(name, F.lit(True if self.everything else None).cast("boolean"))
        # at most SkewPolicy.max_hot_keys rows, see find_hot_keys
        flagged = self.table.select(*[F.col(k).alias(f"_hot_{k}") for k in self.key], value.alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in self.key]
        return df.join(F.broadcast(flagged), reduce(Column.__and__, same), "left").drop(*[f"_hot_{k}" for k in self.key])


def every_key(*key: str) -> HotKeys:
    """For low-cardinality keys (zones, statuses): each one is certain to be large."""
    return HotKeys(key, everything=True)


def no_hot_keys(*key: str) -> HotKeys:
    return HotKeys(key)


def find_hot_keys(df: DataFrame, *key: str, position: Column | None = None,
                  policy: SkewPolicy = SkewPolicy()) -> HotKeys:
    """Find keys with more than about ``policy.hot_rows`` rows by a seeded sample, and how wide their slices must be.

    Reads the key columns and ``position`` (default: ``seq`` if there is one) only. Null is a key
    like any other. A key's slices are as wide as its own positions are sparse, for about
    ``hot_rows`` rows each. Should more than ``max_hot_keys`` keys be that large, those are
    hot that hold more than one ``max_hot_keys``-th of all rows, of which there are fewer. A key the sample
    misses merely stays in one slice.
    """
    fraction = min(1.0, policy.sample_hits / policy.hot_rows)
    needed = fraction * policy.hot_rows
    if position is None and "seq" in df.columns:
        position = F.col("seq")
    place = F.lit(None).cast("long") if position is None else position
    counts = df.select(*key, place.alias("_at")).sample(fraction, seed=17).groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), (F.max("_at") - F.min("_at") + 1).alias("_span"))
    heavy = counts.filter(F.col("_n") > needed).orderBy(F.desc("_n"), *key).limit(policy.max_hot_keys + 1).collect()
    if len(heavy) > policy.max_hot_keys:
        needed = counts.agg(F.sum("_n")).first()[0] / policy.max_hot_keys
        heavy = [r for r in heavy if r["_n"] > needed]
    if not heavy:
        return HotKeys(key)

    def width(r) -> int | None:
        return None if r["_span"] is None else max(1, math.ceil(r["_span"] / math.ceil(r["_n"] / needed)))

    schema = StructType([*df.select(*key).schema.fields, StructField("width", LongType())])
    for f in schema.fields:
        f.nullable = True
    return HotKeys(key, df.sparkSession.createDataFrame([(*(r[k] for k in key), width(r)) for r in heavy], schema))


def depth_cells(df: DataFrame, key: tuple[str, ...], position: Column, rows: int, cells: int = CELLS) -> DataFrame:
    """Per key, ``_cells`` (low, width, base): where slices of about ``rows`` rows lie, however its positions are spread.

    A quantile sketch cuts each key's positions into cells of equal depth, and cells of more than ``rows`` rows are cut evenly;
    ``base`` numbers a cell's first slice. One aggregate that combines before its shuffle; as many rows as there are keys.
    """
    edges = [i / cells for i in range(1, cells)]
    found = df.select(*key, position.alias("_at")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_lo"), F.max("_at").alias("_hi"), F.percentile_approx("_at", edges, 10 * cells).alias("_q"))
    whole = F.col("_n") <= rows
    lows = F.when(whole, F.array("_lo")).otherwise(F.array_sort(F.array_distinct(F.concat(F.array("_lo"), "_q"))))
    each = F.when(whole, 1).otherwise(F.ceil(F.col("_n") / F.lit(cells * rows))).cast("long")
    def cell(low: Column, i: Column) -> Column:
        end = F.coalesce(F.get("_lows", i + 1), F.col("_hi") + 1)
        width = F.greatest(F.ceil((end - low) / F.col("_each")), F.lit(1)).cast("long")
        return F.struct(low.alias("low"), width.alias("width"), (i * F.col("_each")).cast("long").alias("base"))

    return found.withColumns({"_lows": lows, "_each": each}).select(*key, F.transform("_lows", cell).alias("_cells"))


def sliced(df: DataFrame, hot: HotKeys, position: Column, width: int) -> DataFrame:
    """Add the slice number; ``position`` is a long, ``width`` the rows of a slice, and its span where the key has none of its own."""
    if hot.everything:
        # every_key is for low-cardinality keys: a row for each
        cells = depth_cells(df, hot.key, position, width).withColumnsRenamed({k: f"_of_{k}" for k in hot.key})
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in hot.key]
        placed = df.withColumn("_at", position).join(F.broadcast(cells), reduce(Column.__and__, same)).withColumn(
            "_cell", F.element_at(F.filter("_cells", lambda c: c["low"] <= F.col("_at")), -1))
        number = F.col("_cell.base") + F.floor((F.col("_at") - F.col("_cell.low")) / F.col("_cell.width"))
        return placed.withColumn(SLICE, number.cast("long")).select(*df.columns, SLICE)
    marked = hot.mark(df, _WIDTH, F.coalesce(F.col("width"), F.lit(width)))
    number = F.floor(position / F.col(_WIDTH)).cast("long")
    return marked.withColumn(SLICE, F.coalesce(number, F.lit(_COLD))).drop(_WIDTH)


def with_neighbour(
    df: DataFrame, hot: HotKeys, order: list[str], payload: list[str], name: str, *,
    following: bool = False, position: Column | None = None, policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Add the key's previous (or following) row as columns ``<name>_<column>``.

    They cover ``payload`` and the first order column; the latter is null exactly where there
    is no such row. ``order`` must be total within a key; ``position`` is a long that never
    decreases along it (default: its first column).

    Each column is looked up by itself: a struct of them would have to be built before the
    shuffle, which would then carry the payload twice.
    """
    key, step = list(hot.key), F.lead if following else F.lag
    wanted = list(dict.fromkeys([*payload, order[0]]))
    named = [f"{name}_{c}" for c in wanted]

    def looked_up(rows: DataFrame, *within: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(*order)
        return rows.select("*", *[step(c).over(w).alias(n) for c, n in zip(wanted, named)])

    if not hot:
        return looked_up(df, *key)

    tagged = sliced(df, hot, F.col(order[0]) if position is None else position, policy.hot_rows)
    edge = (F.min_by if following else F.max_by)(F.struct(*wanted), F.struct(*order))
    edges = tagged.filter(F.col(SLICE) != _COLD).groupBy(*key, SLICE).agg(edge.alias("_edge"))
    carried = edges.select(
        *key, SLICE, step("_edge").over(Window.partitionBy(*key).orderBy(SLICE)).alias("_carried"),
    ).filter(F.col("_carried").isNotNull())
    rows = _seeded(tagged, carried, hot, {c: F.col(f"_carried.{c}") for c in wanted})
    seed_order = F.asc(_SEED) if following else F.desc(_SEED)
    w = Window.partitionBy(*key, SLICE).orderBy(seed_order, *order)
    found = rows.select("*", *[step(c).over(w).alias(n) for c, n in zip(wanted, named)])
    return found.filter(~F.col(_SEED)).select(*df.columns, *named)


def _seeded(tagged: DataFrame, carried: DataFrame, hot: HotKeys, values: dict[str, Column]) -> DataFrame:
    """``tagged`` and, in each slice that something is carried into, one more row that holds it; placed by slice.

    What is carried comes from an aggregate that combines before its shuffle, and reaches the slice as a row
    instead of by a join, so every row is shuffled once, and null keys are keys like any other.
    """
    own = {*hot.key, SLICE}
    filled = [
        F.col(f.name) if f.name in own else values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in tagged.schema.fields]
    seeds = carried.select(*filled, F.lit(True).alias(_SEED))
    # Explicit, because a partitioning by the key alone (after a join, say) would also be
    # accepted for the windows to come and bring the hot key back together.
    return tagged.withColumn(_SEED, F.lit(False)).unionByName(seeds).repartition(*hot.key, SLICE)


def with_running_sum(
    df: DataFrame, hot: HotKeys, order: list[str], value: Column, name: str, *,
    position: Column | None = None, policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the key's rows up to and including this one."""
    key, columns = list(hot.key), df.columns
    df = df.withColumn("_value", value)
    frame = (Window.unboundedPreceding, Window.currentRow)
    if not hot:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(*frame)
        return df.withColumn(name, F.sum("_value").over(w)).drop("_value")

    tagged = sliced(df, hot, F.col(order[0]) if position is None else position, policy.hot_rows)
    totals = tagged.filter(F.col(SLICE) != _COLD).groupBy(*key, SLICE).agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*key, SLICE, F.sum("_total").over(before).alias("_base")).filter(
        F.col("_base").isNotNull())
    wide = tagged.withColumn("_value", F.col("_value").cast(totals.schema["_total"].dataType))
    rows = _seeded(wide, bases, hot, {"_value": F.col("_base")})
    w = Window.partitionBy(*key, SLICE).orderBy(F.desc(_SEED), *order).rowsBetween(*frame)
    return rows.withColumn(name, F.sum("_value").over(w)).filter(~F.col(_SEED)).select(*columns, name)


def join_dimension(
    facts: DataFrame, dimension: DataFrame, hot: HotKeys, salt_source: str, how: str = "left",
    policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Join facts to a table with one row per key, spreading the facts of hot keys.

    Only the dimension rows of hot keys are repeated, once per salt.
    """
    key = list(hot.key)
    if not hot:
        return facts.join(dimension, key, how)
    spread = F.pmod(F.xxhash64(salt_source), F.lit(policy.salts)).cast("int")
    salted = hot.mark(facts, "_hot").withColumn(
        "_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(policy.salts - 1)))
    repeated = hot.mark(dimension, "_hot").withColumn(
        "_salt", F.explode(salts.otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(repeated, [*key, "_salt"], how).drop("_salt")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

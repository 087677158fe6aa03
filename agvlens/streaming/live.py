"""Running views of the feed: the board folded as patches arrive, and rates over sliding windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from ..operators import board, feed, metrics
from ..schemas import BOARD
from .jobs import passed_over, start_batches
from .store import BatchStore


@dataclass
class BoardJob:
    """The board after every micro-batch of feed messages, started from a snapshot.

    The last patch of each id lives in the state store, so patches that arrive out of order change nothing wrongly, and a batch hands on the
    ids it changed; these are folded into a keyed table of the board, of which a batch reads and rewrites the buckets it touches.
    """

    spark: SparkSession
    root: str
    buckets: int = 16
    store: BatchStore = field(init=False)

    def __post_init__(self):
        self.store = BatchStore(self.spark, self.root)

    def seed(self, vehicles: DataFrame, zones: DataFrame, anomalies: DataFrame) -> None:
        """Put a snapshot's tables on the board, once, before the first batch."""
        if self.store.pointer()["n"] < 0:
            rows = board.snapshot_rows(vehicles, zones, anomalies).withColumn("key", _key())
            self.store.write_keyed(rows.select(*BOARD.names), "board", "key", -1, self.buckets)
            self.store.commit(-1)

    def start(self, messages: DataFrame, **trigger) -> StreamingQuery:
        """``messages`` is a stream of feed messages (seq, slot, value)."""
        patches = board.patch_rows(feed.parse_patches(messages))
        last = patches.groupBy("type", "id").agg(F.max_by(F.struct(*board.FIELDS), "place").alias("last"))
        return start_batches(last, self.process, f"{self.root}/_checkpoint", "update", **trigger)

    def board(self) -> DataFrame:
        return self.store.keyed("board", BOARD).drop("key")

    def process(self, changed: DataFrame, batch_id: int) -> None:
        if batch_id <= self.store.last_committed():
            return passed_over(changed)
        changed = changed.select(_key().alias("key"), "type", "id", "last.*").persist()
        try:
            self.store.upsert(changed, "board", BOARD, "key", batch_id, self.buckets, _patched)
            self.store.commit(batch_id)
        finally:
            changed.unpersist()


def _key() -> Column:
    return F.concat_ws(" ", "type", "id")


def _patched(known: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of the board with those that changed in their new form; unknown ids only where a patch may add them."""
    both = known.withColumn("new", F.lit(False)).unionByName(changes.withColumn("new", F.lit(True)), allowMissingColumns=True)
    newest = F.max_by(F.struct("type", "id", *board.FIELDS), "new").alias("row")
    folded = both.groupBy("key").agg(F.bool_or(~F.col("new")).alias("known"), newest).select("key", "known", "row.*")
    return folded.filter(F.col("known") | board.may_be_added()).select(*BOARD.names)


@dataclass
class RateJob:
    """Counts over windows of ``minutes`` that start every minute, of rows (ts, by) as they arrive.

    The clock is the newest ``ts`` of earlier batches less ``lateness_s``; rows it has passed are counted for no window and kept in a table
    of their own. A batch appends its counts per minute, which is all that is kept of other rows; windows are summed from them when read.
    """

    spark: SparkSession
    root: str
    by: Sequence[str] = ("type",)
    minutes: int = 4
    lateness_s: int = 600
    store: BatchStore = field(init=False)

    def __post_init__(self):
        self.store = BatchStore(self.spark, self.root)

    def start(self, rows: DataFrame, **trigger) -> StreamingQuery:
        self._row = StructType([rows.schema[c] for c in ("ts", *self.by)])
        return start_batches(rows.select("ts", *self.by), self.process, f"{self.root}/_checkpoint", **trigger)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.store.last_committed():
            return
        batch = batch.persist()
        try:
            newest = batch.agg(F.max(F.unix_micros("ts"))).first()[0]  # one value
            passed = self.store.note("passed")
            late = F.lit(False) if passed is None else F.coalesce(F.unix_micros("ts") <= passed, F.lit(False))
            self.store.write_all({
                "minutes": metrics.per_minute(batch.filter(~late & F.col("ts").isNotNull()), self.by).coalesce(1),  # few rows
                "late": batch.filter(late)}, batch_id)
            seen = [x for x in (passed, None if newest is None else newest - self.lateness_s * 1_000_000) if x is not None]
            self.store.commit(batch_id, passed=max(seen, default=None))
        finally:
            batch.unpersist()

    def rates(self) -> DataFrame:
        keys = [f for f in self._row.fields if f.name != "ts"]
        counts = StructType([StructField("minute", TimestampType(), True), *keys, StructField("n", LongType(), True)])
        return metrics.sliding_over(self.store.read("minutes", counts), self.by, self.minutes)

    def late(self) -> DataFrame:
        return self.store.read("late", self._row).drop("batch_id")

"""The streaming jobs: telemetry, status commands, and running aggregates."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..config import SkewPolicy, Thresholds
from ..operators import comms, faults, feed, zones
from ..operators.rules import RULES, fired
from ..operators.skew import no_hot_keys
from ..operators.state import current_state, last_status
from ..schemas import (
    ANOMALIES, CHANGE_FEED, CURRENT_STATE, FLEET, OPENED_RECORDS, OUTCOMES, TELEMETRY, TRANSITIONS, ZONE_COUNTS,
)
from ..sources.writers import publish_version
from . import vehicles as tracking
from .store import BatchStore, pieces_of

LATE = StructType([*TELEMETRY.fields, StructField("fate", StringType(), True)])


def start_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                  output_mode: str = "append", **trigger) -> StreamingQuery:
    """Run ``handle(batch, batch_id)`` on each micro-batch; default: what is there, then stop."""
    # state grows with the number of vehicles: keep it on disk, not on the heap
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", tracking.ROCKSDB)
    return (
        stream.writeStream.outputMode(output_mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def passed_over(batch: DataFrame) -> None:
    """Run a batch whose results are committed already: the state store still waits for its version of the state."""
    batch.write.format("noop").mode("overwrite").save()


def newer_state(known: DataFrame, changes: DataFrame) -> DataFrame:
    """The last arrival of each vehicle among two state tables."""
    return current_state(known.unionByName(changes).withColumnRenamed("last_seq", "seq"))


def found_in(batch: DataFrame, thresholds: Thresholds) -> DataFrame:
    """The anomalies of a batch of :func:`~agvlens.streaming.vehicles.tracked`: of its readings and its silences."""
    silences = batch.filter(F.col("fate") == tracking.SILENCE).select(
        "seq", F.lit(len(RULES)).alias("rule_ord"), "vehicle_id", F.lit(comms.COMMS_LOSS).alias("anomaly_type"),
        comms.comms_loss_detail(thresholds).alias("detail"), F.col("silent_at").alias("detected_at"))
    return fired(batch.filter(F.col("fate") == tracking.READING), thresholds=thresholds).unionByName(silences)


@dataclass
class TelemetryJob:
    """Log, state, zone counters, anomalies and change feed of each micro-batch, committed together.

    Previous readings and silences come from Spark's state store; the state that others read is a keyed table of ``buckets``
    buckets, of which a batch reads and rewrites those its vehicles are in (choose about a bucket for every few thousand vehicles).
    ``seq`` must grow from batch to batch for a vehicle, as offsets do. With ``lateness`` the job is on event time: late and
    repeated readings go to a table of their own and change nothing else.
    """

    spark: SparkSession
    root: str
    thresholds: Thresholds = Thresholds()
    policy: SkewPolicy = SkewPolicy()
    buckets: int = 16
    lateness: str | None = None
    store: BatchStore = field(init=False)

    def __post_init__(self):
        self.store = BatchStore(self.spark, self.root)

    def start(self, readings: DataFrame, ticks: DataFrame | None = None, **trigger) -> StreamingQuery:
        """``ticks`` (column ``now``) are the clock by which vehicles are silent, see :func:`clock`."""
        rows = tracking.tracked(readings, ticks, self.thresholds, self.lateness)
        return start_batches(rows, self.process, f"{self.root}/_checkpoint", **trigger)

    # -- committed results ---------------------------------------------------------------

    def log(self, days: tuple | None = None) -> DataFrame:
        """All readings, or those recorded from one day to another."""
        return self.store.read("log", TELEMETRY, days)

    def anomalies(self, days: tuple | None = None) -> DataFrame:
        """Anomalies of rules and silences."""
        return self.store.read("anomalies", ANOMALIES, days)

    def change_feed(self, days: tuple | None = None) -> DataFrame:
        return self.store.read("feed", CHANGE_FEED, days)

    def late(self) -> DataFrame:
        """Readings that came too late or again, with their ``fate``; empty without ``lateness``."""
        return self.store.read("late", LATE)

    def state(self) -> DataFrame:
        return self.store.keyed("state", CURRENT_STATE)

    def zone_counts(self) -> DataFrame:
        """The counters after the last batch; every batch writes all of them."""
        return zones.seed_zones(self.store.newest_part("zone_counts", ZONE_COUNTS))

    # -- one micro-batch -----------------------------------------------------------------

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """``batch`` holds rows of :func:`~agvlens.streaming.vehicles.tracked`."""
        if batch_id <= self.store.last_committed():
            return passed_over(batch)  # replayed after its commit
        batch = batch.persist()
        try:
            pieces = pieces_of(batch)  # fills the cache by one job, for the outputs to read at the same time
            plain = batch.filter(F.col("fate") == tracking.READING).select(*TELEMETRY.names)
            found = found_in(batch, self.thresholds)
            base = self.zone_counts()
            totals = base.unionByName(zones.entries_per_zone(plain)).groupBy("zone_id").agg(F.sum("entry_count").alias("entry_count"))
            # a micro-batch is as large as its trigger allows, so its zones need no slices
            patches = feed.change_feed_of(plain, found, base, self.policy, small=True)
            outputs = {
                "log": (plain, F.to_date("recorded_at")),
                "anomalies": (found, F.to_date("detected_at")),
                "zone_counts": totals.coalesce(1),  # 20 rows
                "feed": (patches, F.to_date("ts")),
            }
            if self.lateness is not None:
                outputs["late"] = batch.filter(F.col("fate").isin(tracking.LATE, tracking.REPEAT)).select(*LATE.names)
            with ThreadPoolExecutor(1) as pool:
                kept = pool.submit(inheritable_thread_target(self.spark)(self._keep_state), plain, batch_id)
                self.store.write_all(outputs, batch_id, pieces)
                kept.result()
            self.store.commit(batch_id)
        finally:
            batch.unpersist()

    def _keep_state(self, readings: DataFrame, batch_id: int) -> None:
        self.store.upsert(current_state(readings), "state", CURRENT_STATE, "vehicle_id", batch_id, self.buckets, newer_state)


@dataclass
class StatusCommandJob:
    """Outcomes, transitions and opened records of status commands, committed together.

    What commands depend on (a vehicle's status, its active mission, whether a record is open) is a keyed table, made once from the tables
    given; a batch reads and rewrites the buckets that its vehicles are in.
    """

    spark: SparkSession
    root: str
    vehicles: DataFrame
    missions: DataFrame
    open_records: DataFrame
    policy: SkewPolicy = SkewPolicy()
    buckets: int = 16
    store: BatchStore = field(init=False)

    def __post_init__(self):
        self.store = BatchStore(self.spark, self.root)

    def start(self, commands: DataFrame, **trigger) -> StreamingQuery:
        return start_batches(commands, self.process, f"{self.root}/_checkpoint", **trigger)

    # -- committed results ---------------------------------------------------------------

    def outcomes(self) -> DataFrame:
        return self.store.read("outcomes", OUTCOMES)

    def transitions(self) -> DataFrame:
        return self.store.read("transitions", TRANSITIONS)

    def records(self) -> DataFrame:
        return self.store.read("records", OPENED_RECORDS)

    def vehicles_now(self) -> DataFrame:
        return self._fleet().filter("known").select("vehicle_id", "status")

    def missions_now(self) -> DataFrame:
        return faults.missions_after(self.missions, self._fleet().filter("faulted"))

    def _fleet(self, numbers: list[int] | None = None) -> DataFrame:
        self._seed()
        return self.store.keyed("fleet", FLEET, numbers)

    def _seed(self) -> None:
        """The fleet as it is before the first command; written once."""
        if "fleet" in self.store.pointer()["buckets"]:
            return
        active = self.missions.filter(F.col("status") == faults.ACTIVE).groupBy("vehicle_id").agg(F.min("mission_id").alias("mission_id"))
        open_now = self.open_records.select("vehicle_id").distinct().withColumn("opened", F.lit(True))
        rows = self.vehicles.withColumn("known", F.lit(True)).join(active, "vehicle_id", "full").join(open_now, "vehicle_id", "full")
        rows = rows.withColumn("faulted", F.lit(False)).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("known", "opened")})
        self.store.write_keyed(rows.select(*FLEET.names), "fleet", "vehicle_id", -1, self.buckets)
        self.store.commit(-1)

    # -- one micro-batch -----------------------------------------------------------------

    def process(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.store.last_committed():
            return
        self._seed()
        batch = batch.persist()
        buckets = self.store.buckets_of("fleet", self.buckets)
        numbers = self.store.touched(batch, "vehicle_id", buckets)
        fleet = self.store.keyed("fleet", FLEET, numbers)
        # a micro-batch is as large as its trigger allows
        resolved = faults.outcomes(batch, fleet.filter("known").select("vehicle_id", "status"), no_hot_keys("vehicle_id"), self.policy).persist()
        try:
            moves = faults.transitions(resolved)
            running = fleet.filter("mission_id is not null and not faulted").select("mission_id", "vehicle_id", F.lit(faults.ACTIVE).alias("status"))
            opened = self.store.write(faults.maintenance_opened(moves, running, fleet.filter("opened")), "records", batch_id)
            last = last_status(resolved.filter(F.col("outcome") != "unknown_vehicle")).withColumnRenamed("status", "last")
            mark = lambda df, name: df.select("vehicle_id").distinct().withColumn(name, F.lit(True))
            changed = fleet.join(last, "vehicle_id", "left").join(mark(moves, "moved"), "vehicle_id", "left").join(mark(opened, "begun"), "vehicle_id", "left")
            after = changed.select(
                "vehicle_id", F.coalesce("last", "status").alias("status"), "known", "mission_id",
                (F.col("faulted") | F.col("moved").isNotNull()).alias("faulted"), (F.col("opened") | F.col("begun").isNotNull()).alias("opened"))
            self.store.write_all({"outcomes": resolved, "transitions": moves}, batch_id)
            if numbers:
                self.store.write_keyed(after, "fleet", "vehicle_id", batch_id, buckets)
            self.store.commit(batch_id)
        finally:
            resolved.unpersist()
            batch.unpersist()


def event_time_view(readings: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Readings without repeated ones and without those later than ``lateness``, which are forgotten.

    ``TelemetryJob(lateness=…)`` does the same and keeps what it turns away; this is for pipelines without its tables.
    """
    return readings.withWatermark("recorded_at", lateness).dropDuplicatesWithinWatermark(["vehicle_id", "recorded_at"])


def clock(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """Ticks of the wall clock."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select(
        F.col("timestamp").alias("now"))


def start_anomalies(readings: DataFrame, root: str, ticks: DataFrame | None = None, thresholds: Thresholds = Thresholds(), **trigger) -> StreamingQuery:
    """Anomalies alone, for the shortest way from a reading to its alarm: one write a micro-batch."""
    store = BatchStore(readings.sparkSession, root)

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= store.last_committed():
            return passed_over(batch)
        batch = batch.persist()
        try:
            store.write(found_in(batch, thresholds), "anomalies", batch_id, F.to_date("detected_at"), pieces_of(batch))
            store.commit(batch_id)
        finally:
            batch.unpersist()

    return start_batches(tracking.tracked(readings, ticks, thresholds), write, f"{root}/_checkpoint", **trigger)


def start_zone_counts(readings: DataFrame, root: str, **trigger) -> StreamingQuery:
    """Zone counters as a streaming aggregate; each batch publishes all 20 as a new version."""
    def publish(counts: DataFrame, batch_id: int) -> None:
        publish_version(zones.seed_zones(counts), f"{root}/zone_counts", batch_id)

    return start_batches(zones.entries_per_zone(readings), publish, f"{root}/_checkpoint", "complete", **trigger)


def start_current_state(readings: DataFrame, root: str, buckets: int = 16, **trigger) -> StreamingQuery:
    """Latest reading per vehicle as a streaming aggregate; each batch folds the changed vehicles into a keyed table."""
    store = BatchStore(readings.sparkSession, root)

    def write(changed: DataFrame, batch_id: int) -> None:
        if batch_id <= store.last_committed():
            return passed_over(changed)
        # as one column: the optimizer loses track of a streaming aggregate's keys behind a cached table
        changed = changed.select(F.struct("*").alias("row")).persist()
        try:
            store.upsert(changed.select("row.*"), "state", CURRENT_STATE, "vehicle_id", batch_id, buckets, newer_state)
            store.commit(batch_id)
        finally:
            changed.unpersist()

    return start_batches(current_state(readings), write, f"{root}/_checkpoint", "update", **trigger)


def read_current_state(spark: SparkSession, root: str) -> DataFrame:
    return BatchStore(spark, root).keyed("state", CURRENT_STATE)


def start_feed_sink(messages: DataFrame, checkpoint: str, fmt: str = "json", **options: str) -> StreamingQuery:
    """Publish feed messages (key, value) to files or Kafka."""
    return (
        messages.writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

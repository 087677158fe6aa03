import random

import pytest
from conftest import at, rows_of
from pyspark.sql import functions as F

from agvlens.config import ZONES
from agvlens.operators import board, comms, faults, feed, rules, state, zones
from agvlens.schemas import ANOMALIES, CURRENT_STATE, MISSIONS, STATUS_UPDATE, TELEMETRY, VEHICLES
from agvlens.sources import readers, writers
from agvlens.sources.folders import Folder
from agvlens.streaming import jobs, live
from agvlens.streaming.store import BatchStore, bucket_of

FEED = ["seq", "slot", "type", "payload"]


@pytest.fixture
def log(telemetry):
    rnd = random.Random(6)
    return telemetry(*[
        dict(vehicle_id="hot" if i % 3 == 0 else f"v{rnd.randint(0, 9)}", at=i * 0.7 if i % 11 else i - 9,
             battery_pct=rnd.randint(0, 100), speed_mps=rnd.choice([0.05, 2, 7]), pos_x=float(rnd.randint(0, 90)), pos_y=1.0,
             zone_entered=rnd.choice([*ZONES[:4], None, "nowhere"]), status=rnd.choice(["moving", "moving", "fault", "charging"]),
             error_codes=[] if i % 5 else ["E1"])
        for i in range(240)]).cache()


def run_job(job, log, cuts, until=None):
    """Deliver the log in slices, a tick after each, and run the job after every slice."""
    spark, source, ticks = log.sparkSession, f"{job.root}-in", f"{job.root}-ticks"
    bounds = [0, *cuts, 10**9]
    for lo, hi in zip(bounds, bounds[1:]):
        part = log.filter((F.col("seq") >= lo) & (F.col("seq") < hi))
        part.repartition(2).write.mode("append").parquet(source)
        now = part.agg(F.max("recorded_at").alias("now")) if until is None or hi < 10**9 else spark.createDataFrame([(until,)], "now timestamp")
        now.coalesce(1).write.mode("append").parquet(ticks)
        job.start(readers.read_telemetry(spark, source, streaming=True), readers.read_table(spark, ticks, "now timestamp", streaming=True)).awaitTermination()


def shown(df, *columns):
    """Rows as text, in which one NaN equals another."""
    return [repr(r) for r in rows_of(df, *columns)]


def results(job):
    return {
        "anomalies": shown(job.anomalies().drop("batch_id")),
        "state": shown(job.state()),
        "zones": shown(job.zone_counts()),
        "feed": shown(job.change_feed(), *FEED),
        "log": shown(job.log().drop("batch_id")),
    }


def expected(log, until):
    return {
        "anomalies": shown(comms.all_anomalies(log, F.lit(until))),
        "state": shown(state.current_state(log)),
        "zones": shown(zones.zone_counts(log)),
        "feed": shown(feed.change_feed(log, until=F.lit(until)), *FEED),
        "log": shown(log),
    }


@pytest.fixture
def tidy_log(telemetry):
    """Recorded in order of arrival, with nulls, NaN and a vehicle without a name."""
    rnd = random.Random(6)
    return telemetry(*[
        dict(vehicle_id=rnd.choice(["hot", "hot", None, *[f"v{n}" for n in range(9)]]), at=i * 0.7 + (30 if i > 150 else 0),
             battery_pct=rnd.choice([None, float("nan"), 3, 50, 90]), speed_mps=rnd.choice([0.05, 2, 7, float("nan")]),
             pos_x=rnd.choice([None, float("nan"), 1.0, 900.0]), pos_y=1.0, zone_entered=rnd.choice([*ZONES[:4], None, "nowhere"]),
             status=rnd.choice(["moving", "moving", "fault", "charging"]), error_codes=[] if i % 5 else ["E1", "E2"])
        for i in range(240)]).cache()


@pytest.mark.parametrize("cuts", [[], [37, 151, 200]])
def test_any_split_gives_the_batch_result(spark, tidy_log, tmp_path, cuts):
    job = jobs.TelemetryJob(spark, str(tmp_path / "job"))
    run_job(job, tidy_log, cuts, at(400))
    want = expected(tidy_log, at(400))
    assert results(job) == want
    assert sum(r[-1] == 7 for r in rows_of(comms.all_anomalies(tidy_log, F.lit(at(400))), "seq", "rule_ord")) > 10
    if cuts:  # the same anomalies by the job that writes nothing else
        class Alone:
            root = str(tmp_path / "alone")

            def start(self, readings, ticks):
                return jobs.start_anomalies(readings, self.root, ticks)

        run_job(Alone(), tidy_log, [100], at(400))
        assert shown(BatchStore(spark, Alone.root).read("anomalies", ANOMALIES).drop("batch_id")) == want["anomalies"]


def test_older_readings_replace_newer_ones(spark, log, tmp_path):
    """Readings recorded out of order, in one batch: arrival decides."""
    job = jobs.TelemetryJob(spark, str(tmp_path / "job"))
    run_job(job, log, [])
    assert rows_of(job.state()) == rows_of(state.current_state(log))
    assert rows_of(job.anomalies().filter("rule_ord < 7").drop("batch_id")) == rows_of(rules.detect(log))


def test_ticks_alone_tell_every_silence_at_its_second(spark, telemetry, tmp_path):
    job = jobs.TelemetryJob(spark, str(tmp_path / "job"))
    source, ticks = str(tmp_path / "in"), str(tmp_path / "ticks")
    telemetry(dict(vehicle_id="a", at=0), dict(vehicle_id="b", at=3.5), dict(vehicle_id="c", at=2)).write.parquet(source)

    def run(*seconds):
        spark.createDataFrame([(at(s),) for s in seconds], "now timestamp").coalesce(1).write.mode("append").parquet(ticks)
        job.start(readers.read_telemetry(spark, source, streaming=True), readers.read_table(spark, ticks, "now timestamp", streaming=True)).awaitTermination()
        return rows_of(job.anomalies().filter("rule_ord = 7"), "vehicle_id", "detected_at")

    naive = lambda s: at(s).replace(tzinfo=None)
    assert run(1) == []
    assert run(6) == [("a", naive(6))]
    assert run(7, 8, 30) == [("a", naive(6)), ("b", naive(9)), ("c", naive(8))]  # three ticks and two silences in one batch
    telemetry(dict(seq=9, vehicle_id="c", at=31)).write.mode("append").parquet(source)
    assert len(run(32)) == 3
    found = run(100)
    assert len(found) == 4 and ("c", naive(37)) in found and run(200) == found
    assert job.log().count() == 4


def test_replay_and_crash(spark, tidy_log, tmp_path):
    job = jobs.TelemetryJob(spark, str(tmp_path / "job"))
    run_job(job, tidy_log.filter("seq < 120"), [80])
    before, last = results(job), job.store.last_committed()
    commit = job.store.commit
    job.store.commit = lambda n, **kw: (_ for _ in ()).throw(RuntimeError("lost"))
    source, ticks = f"{job.root}-in", f"{job.root}-ticks"
    streams = lambda: (readers.read_telemetry(spark, source, streaming=True), readers.read_table(spark, ticks, "now timestamp", streaming=True))
    tidy_log.filter("seq >= 120").write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        job.start(*streams()).awaitTermination()
    assert results(job) == before and job.store.last_committed() == last  # nothing of a batch that died is seen
    job.store.commit = commit
    spark.createDataFrame([(at(400),)], "now timestamp").write.mode("append").parquet(ticks)
    job.start(*streams()).awaitTermination()
    assert results(job) == expected(tidy_log, at(400))
    # a batch that is run again after its commit changes nothing
    rows = spark.createDataFrame([], "seq long")
    job.process(rows, 0)
    assert results(job) == expected(tidy_log, at(400))


def test_event_time_mode_sets_late_and_repeated_readings_aside(spark, telemetry, tmp_path):
    rows = [dict(seq=i, vehicle_id=f"v{i % 3}", at=i) for i in range(60)]
    first = telemetry(*rows, dict(seq=100, vehicle_id="v0", at=57), dict(seq=101, vehicle_id="v1", at=57))
    second = telemetry(dict(seq=200, vehicle_id="v2", at=59), dict(seq=201, vehicle_id="v2", at=44.9), dict(seq=202, vehicle_id="v2", at=60), dict(seq=203, vehicle_id="v2", at=60))
    job = jobs.TelemetryJob(spark, str(tmp_path / "job"), lateness="10 seconds")
    for part in (first, second):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        job.start(readers.read_telemetry(spark, str(tmp_path / "in"), streaming=True)).awaitTermination()
    assert rows_of(job.late(), "seq", "fate") == [(100, "repeat"), (200, "repeat"), (201, "late"), (203, "repeat")]
    assert job.log().count() == 62 and job.state().filter("vehicle_id = 'v2'").first()["last_seq"] == 202


def test_batches_open_the_buckets_they_touch(spark, tmp_path):
    """What a batch reads and writes of the state follows the batch, not the fleet."""
    store = BatchStore(spark, str(tmp_path / "s"))
    row = ["'idle' as status", "1.0D as battery_pct", "timestamp'2031-01-01' as recorded_at", "0.0D as speed_mps", "0.0D as pos_x", "0.0D as pos_y"]
    fleet = spark.range(2000).selectExpr("concat('v', id) as vehicle_id", *row, "id as last_seq").select(*CURRENT_STATE.names)
    store.upsert(fleet, "state", CURRENT_STATE, "vehicle_id", 0, 64, jobs.newer_state)
    store.commit(0)
    assert len(store.pointer()["buckets"]["state"]["at"]) == 64
    changes = fleet.filter("vehicle_id in ('v7', 'v8')").withColumns({"status": F.lit("fault"), "last_seq": F.lit(9000).cast("long")})
    numbers = store.touched(changes, "vehicle_id", 64)
    opened = store.keyed("state", CURRENT_STATE, numbers).inputFiles()
    assert len(numbers) <= 2 and {int(f.split("bucket=")[1].split("/")[0]) for f in opened} == set(numbers)
    store.upsert(changes, "state", CURRENT_STATE, "vehicle_id", 1, 99, jobs.newer_state)  # the table's own number of buckets counts
    store.commit(1)
    at_version = store.pointer()["buckets"]["state"]["at"]
    assert {b for b, v in at_version.items() if v == 1} == {str(n) for n in numbers}
    now = store.keyed("state", CURRENT_STATE)
    assert now.count() == 2000 and now.filter("status = 'fault'").count() == 2
    assert now.filter(bucket_of("vehicle_id", 64) == numbers[0]).count() > 2


def test_many_batches_leave_few_files_and_readers_keep_theirs(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "s"), fan=4, keep=6)
    schema = spark.range(1).schema
    reader, seen = None, 0
    for n in range(90):
        store.write(spark.range(n, n + 1), "t", n, F.date_add(F.lit("2031-01-01").cast("date"), (F.col("id") % 3).cast("int")))
        store.commit(n)
        if n == 70:
            reader, seen = store.read("t", schema), n + 1
        if n == 71:
            assert reader.count() == seen  # planned before a commit and perhaps a merge, read after it
    rows = store.read("t", schema)
    assert sorted(r["id"] for r in rows.collect()) == list(range(90)) and sorted(r["batch_id"] for r in rows.collect()) == list(range(90))
    parts = store.pointer()["parts"]["t"]
    assert len(parts) <= 3 * 4 and len(rows.inputFiles()) <= 40
    kept = [n for n in Folder(store.root).names("t") if n.startswith("part=")]
    assert len(kept) <= len(parts) + 5 * 6 and len(Folder(store.root).names("_pointer")) <= 8
    days = store.read("t", schema, ("2031-01-02", "2031-01-02"))
    assert days.count() == 30 and "PartitionFilters: [isnotnull(dt" in days._jdf.queryExecution().toString()


def test_board_of_a_stream_equals_the_fold(spark, tidy_log, tmp_path):
    early, late = tidy_log.filter("seq < 100"), feed.change_feed(tidy_log, until=F.lit(at(400))).filter("seq >= 100").cache()
    newest = spark.createDataFrame([("v1", "overspeed", "x", "2031"), ("gone", "stuck", None, "2031")], "vehicle_id string, anomaly_type string, detail string, detected_at string")
    parts = state.current_state(early).filter("vehicle_id <> 'v2'"), zones.zone_counts(early).limit(7), newest
    messages = writers.feed_to_messages(late).select("seq", "slot", "value")
    bad = spark.createDataFrame([(500, 0, "no json"), (501, 0, '{"type":"zone_count_changed","payload":{"zone_id":"nowhere","entry_count":3}}')], messages.schema)
    whole = messages.unionByName(bad)
    job = live.BoardJob(spark, str(tmp_path / "job"), buckets=4)
    job.seed(*parts)
    assert shown(job.board()) == shown(board.snapshot_rows(*parts).select(*job.board().columns))
    for odd in (1, 0):  # the second batch brings older patches
        whole.filter(F.pmod("seq", F.lit(2)) == odd).write.mode("append").parquet(str(tmp_path / "in"))
        job.start(readers.read_table(spark, str(tmp_path / "in"), messages.schema, streaming=True)).awaitTermination()
    folded = board.fold(*parts, feed.parse_patches(whole))
    assert shown(job.board()) == shown(folded.select(*job.board().columns))


def test_running_aggregates(spark, log, tmp_path):
    source, a, b = (str(tmp_path / n) for n in ("in", "zones", "state"))
    for lo, hi in [(0, 90), (90, 240)]:
        log.filter(F.col("seq").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(source)
        stream = readers.read_telemetry(spark, source, streaming=True)
        jobs.start_zone_counts(stream, a).awaitTermination()
        jobs.start_current_state(stream, b).awaitTermination()
    assert rows_of(writers.read_at_version(spark, f"{a}/zone_counts")) == rows_of(zones.zone_counts(log))
    assert rows_of(jobs.read_current_state(spark, b)) == rows_of(state.current_state(log))


def test_status_commands(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "b", "c", "d", "ghost"]), rnd.choice(["fault", "idle"]), f"E{i}") for i in range(60)]
    commands = spark.createDataFrame(rows, STATUS_UPDATE).cache()
    vehicles = spark.createDataFrame([("a", "idle"), ("b", "fault"), ("c", "moving"), ("d", "idle")], VEHICLES)
    missions = spark.createDataFrame([(1, "a", "active"), (2, "c", "active"), (3, "c", "completed"), (4, "elsewhere", "active")], MISSIONS)
    open_records = spark.createDataFrame([("c",), ("elsewhere",)], "vehicle_id string")
    whole = faults.outcomes(commands, vehicles)
    moves = faults.transitions(whole)
    for n, cuts in enumerate([[], [1, 20, 41]]):
        job = jobs.StatusCommandJob(spark, str(tmp_path / f"job{n}"), vehicles, missions, open_records, buckets=4)
        bounds = [0, *cuts, 10**9]
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            job.process(commands.filter((F.col("seq") >= lo) & (F.col("seq") < hi)), i)
        job.process(commands, 0)  # replayed
        assert rows_of(job.outcomes().drop("batch_id")) == rows_of(whole)
        assert rows_of(job.transitions().drop("batch_id")) == rows_of(moves)
        assert rows_of(job.records().drop("batch_id")) == rows_of(faults.maintenance_opened(moves, missions, open_records))
        assert rows_of(job.vehicles_now()) == rows_of(faults.vehicles_after(commands, vehicles))
        assert rows_of(job.missions_now()) == rows_of(faults.missions_after(missions, moves))


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(LookupError):
        writers.read_at_version(spark, root)
    writers.publish_version(spark.range(1), root, 1)
    writers.publish_version(spark.range(5), root, 2)
    spark.range(9).write.parquet(f"{root}/version=3")  # written but never published
    assert writers.read_at_version(spark, root).count() == 5
    assert writers.read_at_version(spark, root, 1).count() == 1
    with pytest.raises(LookupError):
        writers.read_at_version(spark, root, 3)


def test_raw_log(spark, log, tmp_path):
    path, clustered = str(tmp_path / "raw"), str(tmp_path / "clustered")
    writers.append_raw_log(log.filter("seq < 100"), path)
    writers.append_raw_log(log.filter("seq >= 100"), path)
    assert rows_of(spark.read.parquet(path).select(*TELEMETRY.names)) == rows_of(log)
    writers.cluster_raw_log(log, clustered)
    assert rows_of(spark.read.parquet(clustered).select(*TELEMETRY.names)) == rows_of(log)


def test_feed_sink(spark, log, tmp_path):
    source, out = str(tmp_path / "feed"), str(tmp_path / "out")
    writers.feed_to_messages(feed.change_feed(log)).write.parquet(source)
    stream = spark.readStream.schema("key string, value string, seq long, slot int").parquet(source)
    jobs.start_feed_sink(stream, str(tmp_path / "cp"), path=out).awaitTermination()
    back = feed.parse_patches(spark.read.schema("seq long, slot int, value string").json(out))
    assert back.count() == feed.change_feed(log).count()


def test_event_time_view_drops_repeats(spark, telemetry, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    telemetry(dict(at=0), dict(at=0), dict(at=1), dict(vehicle_id="b", at=0)).write.parquet(source)
    view = jobs.event_time_view(readers.read_telemetry(spark, source, streaming=True))
    view.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_store_reads_nothing_uncommitted(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "s"))
    schema = spark.range(1).schema
    assert store.last_committed() == -1 and store.read("t", schema).count() == 0
    store.write(spark.range(3), "t", 0)
    assert store.read("t", schema).count() == 0 and BatchStore(spark, store.root).last_committed() == -1
    store.commit(0, passed=5)
    assert store.read("t", schema).count() == 3 and store.note("passed") == 5 and store.note("other") is None


def test_folders(tmp_path):
    folder = Folder(f"file://{tmp_path}/f")
    assert folder.names() == [] and not folder.exists("a/x")
    folder.put("a/x", "one")
    folder.put("a/x", "two")
    assert folder.text("a/x") == "two" and folder.names("a") == ["x"]
    folder.remove("a")
    folder.remove("a")
    assert not folder.exists("a/x")


def test_late_rows_of_rates(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame([(at(60 * m), k) for m, k in r], "ts timestamp, type string")
    job = live.RateJob(spark, str(tmp_path / "job"), lateness_s=300)
    for part in (rows((0, "a"), (1, "a"), (30, "b")), rows((25, "a"), (24, "a"), (26, "b")), rows((31, "a"))):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        job.start(readers.read_table(spark, str(tmp_path / "in"), part.schema, streaming=True)).awaitTermination()
    assert rows_of(job.late(), "type") == [("a",), ("a",)]
    counted = {}
    for m, k in ((0, "a"), (1, "a"), (30, "b"), (26, "b"), (31, "a")):
        for w in range(m - 3, m + 1):
            counted[at(60 * w).replace(tzinfo=None), k] = counted.get((at(60 * w).replace(tzinfo=None), k), 0) + 1
    assert {(r["window_start"], r["type"]): r["n"] for r in job.rates().collect()} == counted

"""Queries: the streaming jobs, run over the whole log in several micro-batches.

The log reaches the source folder in slices of the arrival order, and the job runs after each
slice from its checkpoint, so these also exercise restarts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import iso_utc
from ..operators import anomalies, feed, state, zones
from ..operators.rules import RULES
from ..schemas import ANOMALIES, STATUS_UPDATE, TELEMETRY
from ..session import scratch_dir, stored
from ..sources.readers import read_table
from ..sources.writers import feed_to_messages, read_at_version
from ..streaming import jobs, live
from ..streaming.store import BatchStore
from .detection import anomaly_table, instant
from .live_view import APPLIED_SQL, board_text
from .oracle_views import HORIZON, PLAIN_HORIZON, VIEWS
from .readings import HALF, first_half
from .registry import query

SLICES = 3
CLOCK = "now timestamp"


def deliver(log: DataFrame, schema, root: str, run: Callable, slices: int = SLICES, until: Column | None = None) -> None:
    """Write the log to a source folder slice by slice; call ``run(stream)`` after each.

    With ``until``, a tick follows each slice: its newest reading, after the last slice ``until``; then ``run(stream, ticks)`` is called.
    """
    spark, source = log.sparkSession, f"{root}/source"
    span = log.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    if span["lo"] is None:
        return
    width = (span["hi"] - span["lo"]) // slices + 1
    for i in range(slices):
        start = span["lo"] + i * width
        part = log.filter(F.col("seq").between(start, start + width - 1))
        part.write.mode("append").parquet(source)
        stream = read_table(spark, source, schema, streaming=True)
        if until is None:
            run(stream)
            continue
        now = spark.range(1).select(until.alias("now")) if i == slices - 1 else part.agg(F.max("recorded_at").alias("now"))
        now.coalesce(1).write.mode("append").parquet(f"{root}/clock")
        run(stream, read_table(spark, f"{root}/clock", CLOCK, streaming=True))


def telemetry_job(t, log: DataFrame, until: Column | None = None, **options) -> jobs.TelemetryJob:
    """The job after the whole log."""
    job = jobs.TelemetryJob(t.spark, scratch_dir(t.spark, "telemetry-job"), **options)
    deliver(log, TELEMETRY, job.root, lambda *streams: job.start(*streams).awaitTermination(), until=until)
    return job


@query("stream_anomalies", "select seq, rule_ord, vehicle_id, anomaly_type, detail, detected_at from anomalies_fast")
def stream_anomalies(t):
    return telemetry_job(t, t.telemetry_fast(), instant(HORIZON)).anomalies().drop("batch_id")


@query("stream_anomalies_stateful", "select seq, rule_ord, vehicle_id, anomaly_type, detail, detected_at from anomalies_fast")
def stream_anomalies_stateful(t):
    """The anomalies alone, without log, feed and counters."""
    root = scratch_dir(t.spark, "anomaly-stream")
    deliver(t.telemetry_fast(), TELEMETRY, root, lambda s, ticks: jobs.start_anomalies(s, root, ticks).awaitTermination(), 2, instant(HORIZON))
    return BatchStore(t.spark, root).read("anomalies", ANOMALIES).drop("batch_id")


@query("stream_change_feed", "select seq, slot, type, payload from feed")
def stream_change_feed(t):
    return telemetry_job(t, t.telemetry(), instant(PLAIN_HORIZON)).change_feed().select("seq", "slot", "type", "payload")


@query("stream_zone_counts", "select zone_id, entry_count from zone_totals")
def stream_zone_counts(t):
    root = scratch_dir(t.spark, "zone-stream")
    deliver(t.telemetry(), TELEMETRY, root, lambda s: jobs.start_zone_counts(s, root).awaitTermination())
    return read_at_version(t.spark, f"{root}/zone_counts")


@query("stream_current_state", """
select vehicle_id, status, battery_pct, recorded_at, speed_mps, pos_x, pos_y, seq as last_seq from last_reading""")
def stream_current_state(t):
    root = scratch_dir(t.spark, "state-stream")
    deliver(t.telemetry(), TELEMETRY, root, lambda s: jobs.start_current_state(s, root).awaitTermination())
    return jobs.read_current_state(t.spark, root)


@query("stream_comms_loss", """
select seq, vehicle_id, 'comms_loss' as anomaly_type, 'no event for over 5s' as detail, detected_at from episodes""")
def stream_comms_loss(t):
    """Silences told by timers: the same as those of a sweep on every second."""
    found = telemetry_job(t, t.telemetry_fast(), instant(HORIZON)).anomalies()
    return found.filter(F.col("rule_ord") == len(RULES)).select("seq", "vehicle_id", "anomaly_type", "detail", "detected_at")


@query("stream_fault_transitions", "select seq, vehicle_id, prior_status, reason from moves")
def stream_fault_transitions(t):
    root = scratch_dir(t.spark, "command-job")
    job = jobs.StatusCommandJob(t.spark, root, t.vehicles(), t.missions(), t.open_records())
    deliver(t.status_updates(), STATUS_UPDATE, root, lambda s: job.start(s).awaitTermination())
    return job.transitions().drop("batch_id")


@query("stream_board", APPLIED_SQL)
def stream_board(t):
    """The board folded as the second half's messages arrive, from a snapshot of the first half."""
    telemetry, root = t.telemetry(), scratch_dir(t.spark, "board-job")
    before, job = first_half(telemetry), live.BoardJob(t.spark, root)
    found = stored(anomaly_table(t), "anomalies")  # the snapshot and the feed both start from it
    newest = anomalies.latest_per_vehicle(found.filter(F.col("detected_at") < instant(HALF))).withColumn("detected_at", iso_utc(F.col("detected_at")))
    job.seed(state.current_state(before), zones.zone_counts(before), newest)
    feed_to_messages(feed.change_feed_of(telemetry, found).filter(F.col("ts") >= instant(HALF))).select("seq", "slot", "value").write.parquet(f"{root}/messages")
    messages = t.spark.read.parquet(f"{root}/messages")
    deliver(messages, messages.schema, root, lambda s: job.start(s).awaitTermination())
    return board_text(job.board())


# Arrival of a log with late and repeated readings; the same numbers stand in the SQL below.
_LATE_SEQ = "seq * 4 + case when seq % 7 = 3 then 6002 else 0 end"
_LATENESS_S = 6 * 3600


def _disordered(t) -> DataFrame:
    """The plain log, every seventh reading 1500 places late, every tenth sent again at once and every twentieth much later."""
    plain = t.telemetry()
    again = plain.filter("seq % 10 = 0").withColumn("seq", F.expr("seq * 4 + case when seq % 20 = 0 then 8003 else 1 end"))
    return plain.withColumn("seq", F.expr(_LATE_SEQ)).unionByName(again)


VIEWS["sent_log"] = f"""
    select * replace ({_LATE_SEQ} as seq) from telemetry
    union all select * replace (seq * 4 + case when seq % 20 = 0 then 8003 else 1 end as seq) from telemetry where seq % 10 = 0"""
VIEWS["sent_slices"] = f"""
    select *, (seq - (select min(seq) from sent_log)) // ((select max(seq) - min(seq) from sent_log) // {SLICES} + 1) as slice from sent_log"""
VIEWS["sent_clock"] = """
    select slice, max(max(epoch_us(recorded_at))) over (order by slice rows between unbounded preceding and 1 preceding) as newest
    from sent_slices group by slice"""
VIEWS["sent_timed"] = f"""
    select recorded_at as ts, status as type, coalesce(epoch_us(recorded_at) <= newest - {_LATENESS_S}000000, false) as late
    from sent_slices join sent_clock using (slice)"""


@query("stream_event_time", f"""
select seq, vehicle_id, case when late then 'late'
  when row_number() over (partition by vehicle_id, recorded_at, late order by seq) > 1 then 'repeat' else 'reading' end as fate
from (select seq, vehicle_id, recorded_at, coalesce(epoch_us(recorded_at) <= (newest + 1000) // 1000 * 1000 - {_LATENESS_S}000000, false) as late
      from sent_slices join sent_clock using (slice))""")
def stream_event_time(t):
    """The telemetry job on event time: which readings it took, and which came late or again."""
    job = telemetry_job(t, _disordered(t), lateness=f"{_LATENESS_S} seconds")
    return job.log().select("seq", "vehicle_id", F.lit("reading").alias("fate")).unionByName(job.late().select("seq", "vehicle_id", "fate"))


@query("stream_feed_rate", f"""
select window_start, type, cast(sum(n) as bigint) as n, sum(n)/240.0::double as rate_per_s from (
  select unnest(generate_series(minute - interval 3 minute, minute, interval 1 minute)) as window_start, type, n
  from (select date_trunc('minute', ts) as minute, type, count(*) as n from sent_timed where not late group by 1, 2)) group by 1, 2
union all select null, type, count(*), null from sent_timed where late group by type""")
def stream_feed_rate(t):
    """Rates of a disordered log by status over sliding windows, and in rows without a window how many readings came too late for theirs."""
    root = scratch_dir(t.spark, "rate-job")
    job = live.RateJob(t.spark, root, lateness_s=_LATENESS_S)
    deliver(_disordered(t), TELEMETRY, root, lambda s: job.start(s.select(F.col("recorded_at").alias("ts"), F.col("status").alias("type"))).awaitTermination())
    late = job.late().groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    nothing = {"window_start": F.lit(None).cast("timestamp"), "rate_per_s": F.lit(None).cast("double")}
    return job.rates().unionByName(late.withColumns(nothing))

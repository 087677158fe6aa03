"""Queries: the change feed, and the dashboard folded from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import VEHICLE_STATE_CHANGED, ZONE_COUNT_CHANGED
from ..functions import float_text, iso_utc
from ..operators import anomalies, board, feed, state, versions, zones
from ..session import stored
from ..sources.writers import feed_to_messages
from .detection import anomaly_table, instant
from .oracle_views import PLAIN_HORIZON, VIEWS
from .readings import HALF, first_half
from .registry import query


def whole_feed(t):
    """Patches of the plain log's readings, and of its silences."""
    return feed.change_feed(t.telemetry(), until=instant(PLAIN_HORIZON))


@query("change_feed", "select seq, slot, type, payload from feed")
def change_feed(t):
    return whole_feed(t).select("seq", "slot", "type", "payload")


@query("table_changes", """
select id as seq, 'vehicle_state_changed' as type,
  '{"vehicle_id":"' || vehicle_id || '","status":"fault","battery_pct":' || cast(cast(id as double) as varchar) || '}' as payload
from maintenance_records where id%3=0
union all
select id, 'zone_count_changed', '{"zone_id":"aisle_a","entry_count":' || cast(id as varchar) || '}'
from maintenance_records where id%3=1
union all
select id, 'anomaly_detected', '{"vehicle_id":"' || vehicle_id || '","anomaly_type":"error_codes","detail":"' || reason
  || '","detected_at":"' || strftime(opened_at, '%Y-%m-%dT%H:%M:%S.%fZ') || '"}'
from maintenance_records where id%3=2 and id%2=0""")
def table_changes(t):
    """Row changes of four tables, one of them unwatched."""
    which = F.when((F.col("id") % 3 == 2) & (F.col("id") % 2 == 1), 3).otherwise(F.col("id") % 3)
    text = lambda value: F.when(value.isNotNull(), value.cast("string"))
    row = F.struct(
        text(F.col("vehicle_id")).alias("vehicle_id"), F.lit("fault").alias("status"),
        text(F.col("id")).alias("battery_pct"), F.lit("error_codes").alias("anomaly_type"),
        F.col("reason").alias("detail"), iso_utc(F.col("opened_at")).alias("detected_at"),
        F.lit("aisle_a").alias("zone_id"), text(F.col("id")).alias("entry_count"))
    changes = t.maintenance_records().select(
        F.col("id").alias("seq"), F.lit(0).alias("slot"), F.when(which == 0, "vehicle_current_state").when(
            which == 1, "zone_counts").when(which == 2, "anomalies").otherwise("maintenance_records").alias("table"), row.alias("row"))
    return feed.table_changes(changes).select("seq", "type", "payload")


@query("parse_patches", """
select event_id as seq, 'vehicle_state_changed' as type, 'v-' || cast(user_id as varchar) as vehicle_id,
  'moving' as status, value as battery_pct from ev where k%12>=5""")
def parse_patches(t):
    return feed.parse_patches(t.feed_messages()).select(
        "seq", "type", "payload.vehicle_id", "payload.status", "payload.battery_pct")


APPLIED_SQL = f"""
select 'vehicle' as entity, vehicle_id as id, status || ' ' || cast(battery_pct as varchar) as value from last_reading
where vehicle_id in (select vehicle_id from telemetry where recorded_at < timestamp '{HALF}')
union all select 'zone', zone_id, cast(entry_count as varchar) from zone_totals
union all select 'anomaly', vehicle_id, anomaly_type || coalesce(' ' || detail, '') from latest_anomaly"""


def board_text(folded):
    """The board's rows (type, id, fields) as one text each."""
    of = lambda kind, value: F.when(F.col("type") == kind, value)
    return folded.select(
        F.coalesce(of(VEHICLE_STATE_CHANGED, F.lit("vehicle")), of(ZONE_COUNT_CHANGED, F.lit("zone")), F.lit("anomaly")).alias("entity"), "id",
        F.coalesce(
            of(VEHICLE_STATE_CHANGED, F.concat_ws(" ", "status", float_text("battery_pct"))),
            of(ZONE_COUNT_CHANGED, F.col("entry_count").cast("string")), F.concat_ws(" ", "anomaly_type", "detail")).alias("value"))


@query("apply_patches", APPLIED_SQL)
def apply_patches(t):
    """Snapshot of the first half of the log, then the feed of the second half folded onto it."""
    telemetry = t.telemetry()
    found = stored(anomaly_table(t), "anomalies")  # the snapshot and the feed both start from it
    before = first_half(telemetry)
    later = feed.change_feed_of(telemetry, found).filter(F.col("ts") >= instant(HALF))
    patches = feed.parse_patches(feed_to_messages(later))
    newest = anomalies.latest_per_vehicle(found.filter(F.col("detected_at") < instant(HALF)))
    newest = newest.withColumn("detected_at", iso_utc(F.col("detected_at")))
    return board_text(board.fold(state.current_state(before), zones.zone_counts(before), newest, patches))


@query("ws_snapshot", """
select 'snapshot' as type, '{"fleet":{' || (select string_agg('"' || status || '":' || cast(n as varchar), ',' order by status)
    from (select s.status, count(l.vehicle_id) as n from statuses s left join last_reading l on l.status=s.status group by 1))
  || '},"zones":{' || (select string_agg('"' || zone_id || '":' || cast(entry_count as varchar), ',' order by zone_id)
    from zone_totals) || '}}' as payload""")
def ws_snapshot(t):
    telemetry = t.telemetry()
    envelope = board.snapshot_envelope(state.fleet_state(telemetry), zones.zone_counts(telemetry))
    return envelope.select("type", F.to_json("payload").alias("payload"))


@query("fleet_board", """
select l.vehicle_id, l.status, l.battery_pct, l.battery_pct<20 as battery_low, a.anomaly_type, a.detail, a.detected_at
from last_reading l left join latest_anomaly a on a.vehicle_id=l.vehicle_id""")
def fleet_board(t):
    telemetry = t.telemetry()
    return board.fleet_board(state.current_state(telemetry), anomalies.latest_per_vehicle(anomaly_table(t)))


_STATE_ROWS = "select seq, vehicle_id, status, battery_pct, zone_entered from telemetry"


def _published(t):
    return t.telemetry().select("seq", "vehicle_id", "status", "battery_pct", "zone_entered")


def _altered(t):
    """The same table after a faulty replay: some rows changed, some lost, some there twice."""
    rows = _published(t).withColumn("status", F.when(F.col("seq") % 97 == 0, "fault").otherwise(F.col("status"))).filter("seq % 101 <> 5")
    return rows.unionByName(rows.filter("seq % 103 = 1"))


VIEWS["altered_once"] = """
    select seq, vehicle_id, case when seq%97=0 then 'fault' else status end as status, battery_pct, zone_entered from telemetry where seq%101<>5"""
VIEWS["altered"] = "select * from altered_once union all select * from altered_once where seq%103=1"


@query("versions_differ", f"""
select only_in, count(*) as n, seq, vehicle_id, status, battery_pct, zone_entered from (
  select 'left' as only_in, * from ({_STATE_ROWS} except all select * from altered)
  union all select 'right', * from (select * from altered except all {_STATE_ROWS})) group by all""")
def versions_differ(t):
    return versions.difference(_published(t), _altered(t))


@query("versions_equal", "select true as equal, count(*) as left_rows, count(*) as right_rows, 0::bigint as buckets_differing from telemetry")
def versions_equal(t):
    """A table against itself, in another order and as stored and read back."""
    return versions.same_rows(_published(t), stored(_published(t).repartition(5, "status"), "version"))

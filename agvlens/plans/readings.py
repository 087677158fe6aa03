"""Queries: sources, validation, current state, zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state, validate, zones
from ..session import scratch_dir
from ..sources import readers, writers
from .registry import query

HALF = "2024-01-16"  # splits the log by recorded time where a query needs an earlier part


def first_half(telemetry):
    return telemetry.filter(F.col("recorded_at") < F.lit(HALF).cast("timestamp"))


def codes_text(df):
    return df.withColumn("error_codes", F.array_join("error_codes", ","))


@query("telemetry_scan", """
select seq, vehicle_id, status, battery_pct, recorded_at, zone_entered, speed_mps,
  coalesce(error_code, '') as error_codes, pos_x, pos_y from telemetry""")
def telemetry_scan(t):
    return codes_text(t.telemetry())


@query("raw_event_log", """
select seq, vehicle_id, status, battery_pct, recorded_at, speed_mps, zone_entered, strftime(recorded_at, '%Y-%m-%d') as dt
from telemetry""")
def raw_event_log(t):
    path = scratch_dir(t.spark, "raw-log")
    writers.append_raw_log(t.telemetry(), path)
    return t.spark.read.parquet(path).select(
        "seq", "vehicle_id", "status", "battery_pct", "recorded_at", "speed_mps", "zone_entered",
        F.col("dt").cast("string").alias("dt"))


@query("validate_accept", """
select seq, vehicle_id, status, battery_pct from (
  select t.* replace (e.value as battery_pct) from telemetry t join ev e on e.event_id=t.seq)
where battery_pct between 0 and 100""")
def validate_accept(t):
    ok = validate.accepted(validate.validate_readings(t.telemetry_dirty()))
    return ok.select("seq", "vehicle_id", "status", "battery_pct")


@query("validate_reject_reasons", """
select reject_reason, count(*) as n from bodies where reject_reason is not null group by 1""")
def validate_reject_reasons(t):
    return validate.reject_counts(validate.parse_readings(t.telemetry_json()))


@query("reject_unknown_fields", "select event_id as seq, 'firmware' as unknown_field from ev where k%20=0")
def reject_unknown_fields(t):
    stray = validate.unknown_fields(F.try_parse_json("raw"), readers.TELEMETRY.names)
    return t.telemetry_json().select("seq", F.explode(stray).alias("unknown_field"))


@query("telemetry_defaults", """
select event_id as seq, 'v-' || cast(user_id as varchar) as vehicle_id, 'moving' as status, value as battery_pct,
  ts as recorded_at, cast(null as varchar) as zone_entered, case when c=5 then 0.0 else 2.5 end::double as speed_mps,
  case when c=8 then 'E1,E2' else '' end as error_codes, cast(null as double) as pos_x, cast(null as double) as pos_y
from bodies where reject_reason is null""")
def telemetry_defaults(t):
    return codes_text(validate.accepted(validate.parse_readings(t.telemetry_json())))


@query("canonical_rename", "select seq, vehicle_id, recorded_at, pos_x, pos_y from telemetry")
def canonical_rename(t):
    foreign = t.telemetry().withColumnsRenamed({new: old for old, new in readers.LENIENT_NAMES.items()})
    return readers.canonical_names(foreign).select("seq", "vehicle_id", "recorded_at", "pos_x", "pos_y")


@query("status_update_validate", """
select event_id as seq, 'v-' || cast(user_id as varchar) as vehicle_id,
  case when k%10=0 then 'flying' when k%10=1 then 'idle' when k%10>=4 then 'fault' end as status,
  case when k%10=2 then 'E1' when k%10>=5 then 'E' || cast(k as varchar) end as reason,
  case k%10 when 0 then 'status_unknown' when 1 then 'unknown_field' when 2 then 'status_missing'
    when 3 then 'malformed_body' end as reject_reason
from ev""")
def status_update_validate(t):
    return validate.parse_status_updates(t.status_updates_json())


@query("current_vehicle_state", """
select vehicle_id, status, battery_pct, recorded_at, speed_mps, pos_x, pos_y, seq as last_seq from last_reading""")
def current_vehicle_state(t):
    return state.current_state(t.telemetry())


@query("fleet_state", """
select s.status, count(l.vehicle_id) as n from statuses s left join last_reading l on l.status=s.status group by 1""")
def fleet_state(t):
    return state.fleet_state(t.telemetry())


@query("fleet_size_check", """
select (select count(*) from last_reading) as fleet_total, count(distinct vehicle_id) as vehicles,
  (select count(*) from last_reading)=count(distinct vehicle_id) as consistent from telemetry""")
def fleet_size_check(t):
    return state.fleet_size_check(t.telemetry())


@query("vehicles_list", "select vehicle_id, status, battery_pct from last_reading order by vehicle_id")
def vehicles_list(t):
    return state.vehicle_list(state.current_state(t.telemetry()))


@query("events_per_vehicle", "select vehicle_id, count(*) as n_events from telemetry group by 1")
def events_per_vehicle(t):
    return state.events_per_vehicle(t.telemetry())


@query("prior_reading", """
select seq, vehicle_id, p_status as prior_status, p_battery_pct as prior_battery_pct, p_speed_mps as prior_speed_mps,
  p_pos_x as prior_pos_x, p_pos_y as prior_pos_y, p_recorded_at as prior_recorded_at from prior""")
def prior_reading(t):
    return state.with_prior(t.telemetry()).select(
        "seq", "vehicle_id", *[f"prior_{f}" for f in state.PRIOR_FIELDS])


@query("inter_event_gap", "select seq, vehicle_id, dt as gap_s from prior")
def inter_event_gap(t):
    return state.with_prior(t.telemetry()).select("seq", "vehicle_id", state.gap_seconds().alias("gap_s"))


@query("late_events_audit", """
select vehicle_id, count(*) as readings, count(*) filter (gap<=0) as late_readings, max(case when gap<=0 then -gap end) as max_late_s
from (select vehicle_id, (epoch_us(recorded_at) - epoch_us(lag(recorded_at) over (
        partition by vehicle_id order by seq*2 + case when seq%7=3 then 3001 else 0 end)))/1000000.0::double as gap from telemetry)
group by 1""")
def late_events_audit(t):
    return state.late_readings(state.with_prior(t.telemetry_delayed()))


@query("read_at_version", f"""
select vehicle_id, status, battery_pct from telemetry where recorded_at < timestamp '{HALF}'
qualify row_number() over (partition by vehicle_id order by seq desc)=1""")
def read_at_version(t):
    root = scratch_dir(t.spark, "state-versions")
    writers.publish_version(state.current_state(first_half(t.telemetry())), root, 1)
    writers.publish_version(state.current_state(t.telemetry()), root, 2)
    return writers.read_at_version(t.spark, root, 1).select("vehicle_id", "status", "battery_pct")


@query("zone_counts", "select zone_id, entry_count from zone_totals")
def zone_counts(t):
    return zones.zone_counts(t.telemetry())


@query("unknown_zone_entries", """
select zone_entered as zone_id, count(*) as entry_count from telemetry
where zone_entered not in (select zone_id from zones) group by 1""")
def unknown_zone_entries(t):
    return zones.unknown_zone_entries(t.telemetry())


@query("seed_zones_merge", """
select zone_id, case when zone_id like 'pick%' then 0 else entry_count end as entry_count from zone_totals""")
def seed_zones_merge(t):
    existing = zones.entries_per_zone(t.telemetry()).filter(~F.col("zone_id").startswith("pick"))
    return zones.seed_zones(existing)


@query("zone_running_counts", "select seq, zone_id, entry_count from zone_running")
def zone_running_counts(t):
    return zones.running_counts(t.telemetry()).select("seq", "zone_id", "entry_count")

"""DuckDB definitions of the driver views and of intermediate results, as named CTEs."""

from __future__ import annotations

import re

from ..config import FEED_TYPES, LATENCY_BOUNDS_MS, STATUSES, ZONES

_ZONES = ",".join(f"({i},'{z}')" for i, z in enumerate(ZONES))
_STATUSES = ",".join(f"({i},'{s}')" for i, s in enumerate(STATUSES))
_KINDS = " ".join(f"when {i} then '{t}'" for i, t in enumerate(FEED_TYPES))
_BOUNDS = ",".join(f"({b})" for b in (*LATENCY_BOUNDS_MS, "null"))

HORIZON = "2024-01-01 00:12:00"  # telemetry_fast ends before it
PLAIN_HORIZON = "2024-02-01 00:00:00"  # up to which sweeps ran over the plain log


def _episodes(source: str, until: str) -> str:
    return f"""
        select seq, vehicle_id, make_timestamp(tick) as detected_at from (
          select seq, vehicle_id, (epoch_us(recorded_at)+5000000)//1000000*1000000+1000000 as tick,
            lead(epoch_us(recorded_at)) over (partition by vehicle_id order by seq) as heard from {source})
        where (heard is null or tick<heard) and tick <= epoch_us(timestamp '{until}')"""


VIEWS: dict[str, str] = {
    "zones": f"select * from (values {_ZONES}) as z(ord, zone_id)",
    "statuses": f"select * from (values {_STATUSES}) as s(ord, status)",
    "bounds": f"select cast(le as double) as le from (values {_BOUNDS}) as b(le)",
    "ev": "select event_id, user_id, event_type, value, ts,"
          " cast(regexp_extract(props, '([0-9]+)', 1) as int) as k from events",
    "telemetry": """
        select e.event_id as seq, 'v-' || cast(e.user_id as varchar) as vehicle_id,
          case when e.event_type in ('view','click') then 'moving' when e.event_type='error' and e.k%2=0 then 'fault'
               when e.event_type='error' then 'moving' when e.event_type='purchase' then 'charging' else 'idle' end as status,
          cast(e.k as double) as battery_pct, e.ts as recorded_at,
          case when e.event_id%25=19 then 'zone-07' else z.zone_id end as zone_entered,
          case when e.k%4=1 then cast(0.0625 as double) else cast(e.k as double)/cast(16 as double) end as speed_mps,
          case when e.event_type='error' then 'E' || cast(e.k as varchar) end as error_code,
          case when e.k%10=9 then null else cast(e.k as double)*10000 end as pos_x, e.value*1000 as pos_y
        from ev e left join zones z on z.ord=e.event_id%25 and z.ord<19""",
    "fast": """
        select * replace (
          make_timestamp(1704067200000000 + cast(floor((epoch_us(recorded_at)-1704067200000000)/3600) as bigint)) as recorded_at,
          pos_x/3600 as pos_x, pos_y/3600 as pos_y) from telemetry""",
    "vehicles": """
        select distinct 'v-' || cast(user_id as varchar) as vehicle_id,
          case user_id%4 when 0 then 'idle' when 1 then 'moving' when 2 then 'charging' else 'fault' end as status
        from events where user_id%10<>9""",
    "missions": """
        select o_orderkey as mission_id, 'v-' || cast(o_custkey as varchar) as vehicle_id,
          case when o_custkey%3<>0 and o_orderkey=max(o_orderkey) over (partition by o_custkey)
               then 'active' else 'completed' end as status from orders""",
    "open_records": "select distinct 'v-' || cast(user_id as varchar) as vehicle_id from events where user_id%7=3",
    "maintenance_records": """
        select event_id as id, 'v-' || cast(user_id as varchar) as vehicle_id, 'E' || cast(k as varchar) as reason,
          ts as opened_at, case when k%2=0 then ts + interval 1 hour end as resolved_at
        from ev where event_type='error'""",
    "status_updates": """
        select event_id as seq, 'v-' || cast(user_id as varchar) as vehicle_id,
          case event_type when 'error' then 'fault' when 'signup' then 'idle' else 'charging' end as status,
          case when event_type='error' then 'E' || cast(k as varchar) end as reason
        from ev where event_type in ('error','signup','purchase')""",
    "requests": """
        select ts, '/' || event_type as route,
          case when k<3 then 422 when k<5 then 404 when k<6 then 500 else 201 end as status_code, value as duration_ms
        from ev""",
    "unrouted": """
        select ts, case when k%13<>0 then '/' || event_type end as route, '/' || event_type as path,
          case when k<3 then 422 when k<5 then 404 when k<6 then 500 else 201 end as status_code, value as duration_ms
        from ev""",
    "decoding": f"""
        select ts, case k%3 {_KINDS} end as type, value/8 as lag_ms from ev""",
    "spans": """
        select event_id - event_id%4 as trace_id, event_id as span_id,
          case when event_id%4>0 then event_id-1 end as parent_span_id,
          case event_id%4 when 0 then 'browser' when 1 then 'frontend-api' when 2 then 'cdc-consumer' else 'frontend-api' end as service,
          case event_id%4 when 0 then 'documentLoad' when 1 then 'HTTP GET' when 2 then 'cdc.publish' else 'frontend.subscribe' end as name,
          case event_id%4 when 0 then 'CLIENT' when 1 then 'SERVER' when 2 then 'PRODUCER' else 'CONSUMER' end as kind,
          ts as start_ts, value as duration_ms, case when k%2=0 then 'GET' else 'POST' end as method,
          case when k%3=0 then 'db-primary' end as peer
        from ev where k%11<>0""",
    "last_reading": """
        select * from telemetry qualify row_number() over (partition by vehicle_id order by seq desc)=1""",
    "last_fast": """
        select * from fast qualify row_number() over (partition by vehicle_id order by seq desc)=1""",
    "crossings": "select t.seq, t.vehicle_id, t.recorded_at, z.zone_id from telemetry t join zones z on z.zone_id=t.zone_entered",
    "zone_totals": """
        select z.zone_id, count(c.seq) as entry_count from zones z left join crossings c on c.zone_id=z.zone_id group by 1""",
    "zone_running": """
        select seq, zone_id, recorded_at, count(*) over (partition by zone_id order by seq) as entry_count from crossings""",
    "resolved": """
        select c.seq, c.vehicle_id, c.status, c.reason,
          case when v.status is not null then coalesce(c.before, v.status) end as prior_status,
          case when v.status is null then 'unknown_vehicle'
               when c.status='fault' and coalesce(c.before, v.status)='fault' then 'noop' else 'applied' end as outcome
        from (select *, lag(status) over (partition by vehicle_id order by seq) as before from status_updates) c
        left join vehicles v on v.vehicle_id=c.vehicle_id""",
    "moves": "select seq, vehicle_id, prior_status, reason from resolved where status='fault' and outcome='applied'",
    "first_moves": "select * from moves qualify row_number() over (partition by vehicle_id order by seq)=1",
    "episodes": _episodes("fast", HORIZON),
    "silences": _episodes("telemetry", PLAIN_HORIZON),
    "latest_anomaly": """
        select vehicle_id, anomaly_type, detail, detected_at from anomalies
        qualify row_number() over (partition by vehicle_id order by detected_at desc, seq desc, rule_ord desc)=1""",
    "feed": """
        select * from feed_readings
        union all
        select seq, 9, 'anomaly_detected', '{"vehicle_id":"' || vehicle_id || '","anomaly_type":"comms_loss","detail":"'
            || 'no event for over 5s","detected_at":"' || strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%fZ') || '"}', detected_at
        from silences""",
    "feed_readings": """
        select seq, 0 as slot, 'vehicle_state_changed' as type, '{"vehicle_id":"' || vehicle_id || '","status":"' || status
            || '","battery_pct":' || cast(battery_pct as varchar) || '}' as payload, recorded_at as ts from telemetry
        union all
        select seq, 1, 'zone_count_changed', '{"zone_id":"' || zone_id || '","entry_count":' || cast(entry_count as varchar) || '}',
            recorded_at from zone_running
        union all
        select seq, 2+rule_ord, 'anomaly_detected', '{"vehicle_id":"' || vehicle_id || '","anomaly_type":"' || anomaly_type
            || '","detail":' || coalesce('"' || detail || '"', 'null') || ',"detected_at":"'
            || strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%fZ') || '"}', detected_at from fired""",
    "metric_samples": """
        select ts, route, cast(sum(n) over (partition by route, cast(ts as date) order by ts) as double) as value from (
          select date_trunc('minute', ts) as ts, route, count(*) as n from requests group by 1, 2)""",
    "connections": "select date_trunc('minute', ts) as ts, route, count(*) as value from requests group by 1, 2",
    "lag_reported": """
        select ts, case when k%10 in (0,1) then 'standby' else 'standby-' || cast(k%4 as varchar) end as application_name,
          cast(floor(value*1000) as bigint) as lag_bytes from ev where k%5<>4""",
    "buckets": """
        select r.route, b.le, count(*) filter (b.le is null or r.duration_ms<=b.le) as value
        from requests r cross join bounds b group by 1, 2""",
    "bodies": """
        select *, k%20 as c, case
          when k%20=9 then 'malformed_body' when k%20=0 then 'unknown_field' when k%20=6 then 'speed_mps_type'
          when k%20=7 then 'vehicle_id_missing' when k%20=2 then 'vehicle_id_length' when k%20=3 then 'status_unknown'
          when k%20=1 then 'battery_pct_missing' when value>100 then 'battery_pct_range'
          when k%20=4 then 'speed_mps_range' end as reject_reason from ev""",
}


def _stateful(source: str) -> str:
    columns = ("status", "battery_pct", "speed_mps", "pos_x", "pos_y", "recorded_at", "seq")
    lags = ", ".join(f"lag({c}) over (partition by vehicle_id order by seq) as p_{c}" for c in columns)
    return (
        f"select *, (epoch_us(recorded_at)-epoch_us(p_recorded_at))/1000000.0::double as dt"
        f" from (select *, {lags} from {source})"
    )


# type -> (condition, detail), over a *_prior view
RULE_SQL = {
    "fault_status": ("status='fault'", "cast(null as varchar)"),
    "error_codes": ("error_code is not null", "error_code"),
    "low_battery": ("battery_pct<15 and status<>'charging'", "'battery_pct=' || cast(battery_pct as varchar)"),
    "overspeed": ("speed_mps>5", "'speed_mps=' || cast(speed_mps as varchar)"),
    "stuck": (
        "p_status='moving' and status='moving' and p_speed_mps<0.1 and speed_mps<0.1 and dt>=10",
        "'speed_mps=' || cast(speed_mps as varchar) || ', dt=' || cast(dt as varchar) || 's'"),
    "teleport": (
        "dt>0 and sqrt((pos_x-p_pos_x)**2+(pos_y-p_pos_y)**2)/dt>15",
        "'implied_mps=' || printf('%.3f', sqrt((pos_x-p_pos_x)**2+(pos_y-p_pos_y)**2)/dt)"),
    "battery_rising": (
        "p_seq is not null and battery_pct>p_battery_pct and status<>'charging'",
        "cast(p_battery_pct as varchar) || ' -> ' || cast(battery_pct as varchar)"),
}


def rule_sql(name: str, source: str = "prior") -> str:
    condition, detail = RULE_SQL[name]
    order = list(RULE_SQL).index(name)
    return (
        f"select seq, {order} as rule_ord, vehicle_id, '{name}' as anomaly_type, {detail} as detail,"
        f" recorded_at as detected_at from {source} where {condition}"
    )


VIEWS["prior"] = _stateful("telemetry")
VIEWS["prior_fast"] = _stateful("fast")
VIEWS["fired"] = " union all ".join(rule_sql(n) for n in RULE_SQL)
VIEWS["fired_fast"] = " union all ".join(rule_sql(n, "prior_fast") for n in RULE_SQL)
for _table, _rules, _silent in (("anomalies", "fired", "silences"), ("anomalies_fast", "fired_fast", "episodes")):
    VIEWS[_table] = (
        f"select * from {_rules} union all select seq, {len(RULE_SQL)}, vehicle_id, 'comms_loss', 'no event for over 5s',"
        f" detected_at from {_silent}")


def windowed_quantiles_sql(source: str, by: str, value: str, probs: tuple[float, ...] = (0.5, 0.95)) -> str:
    """Hourly quantiles of ``value`` in ``source`` per ``by``, from bucket counters that restart every day."""
    shares = ", ".join(f"({p}::double)" for p in probs)
    return f"""
select window_start, {by}, q, round(case when rank=0 then null when le is null then low when low is null and le<=0 then le
    else coalesce(low, 0) + (le-coalesce(low, 0))*((rank-below)/(value-below)) end, 6) as quantile
from (select *, row_number() over (partition by window_start, {by}, q order by le nulls last) as n from (
    select window_start, {by}, q, le, value, q*max(value) over (partition by window_start, {by}, q) as rank,
      lag(le) over (partition by window_start, {by}, q order by le nulls last) as low,
      coalesce(lag(value) over (partition by window_start, {by}, q order by le nulls last), 0) as below
    from (select date_trunc('hour', ts) as window_start, {by}, le, sum(case when value<was then value else value-was end) as value
          from (select *, lag(value) over (partition by {by}, le order by ts) as was
                from (select ts, {by}, le, sum(n) over (partition by {by}, le, cast(ts as date) order by ts) as value
                      from (select date_trunc('minute', s.ts) as ts, s.{by}, b.le,
                              count(*) filter (b.le is null or s.{value}<=b.le) as n
                            from {source} s cross join bounds b group by all)))
          where was is not null group by all), (values {shares}) as p(q))
  where value>=rank)
where n=1"""


def with_views(sql: str) -> str:
    """Prefix a statement with the CTEs it names, directly or through others."""
    order: list[str] = []

    def visit(text: str, inside: tuple[str, ...] = ()) -> None:
        for word in re.findall(r"[a-z_]+", text):
            if word in VIEWS and word not in order and word not in inside:
                visit(VIEWS[word], (*inside, word))
                order.append(word)

    visit(sql)
    ctes = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in order)
    return f"with {ctes}\n{sql.strip()}" if ctes else sql.strip()

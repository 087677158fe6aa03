"""Queries: anomaly rules, silence, dwell, and reads of the anomalies table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomalies, comms, rules, state
from .oracle_views import HORIZON, PLAIN_HORIZON, rule_sql
from .registry import query


def instant(text: str):
    return F.lit(text).cast("timestamp")


def anomaly_table(t):
    """What the rules and the sweeps found in the plain log."""
    return comms.all_anomalies(t.telemetry(), instant(PLAIN_HORIZON))


def anomaly_table_fast(t):
    return comms.all_anomalies(t.telemetry_fast(), instant(HORIZON))


# The two rules with a time bound need the compressed log; the others read the plain one.
RULE_INPUT = {"stuck": "telemetry_fast", "teleport": "telemetry_fast"}
_SQL_INPUT = {"telemetry": "prior", "telemetry_fast": "prior_fast"}


def _register_rule(rule: rules.Rule) -> None:
    source = RULE_INPUT.get(rule.name, "telemetry")
    sql = f"select seq, vehicle_id, detail, detected_at from ({rule_sql(rule.name, _SQL_INPUT[source])})"

    @query(f"anomaly_{rule.name}", sql)
    def build(t):
        return rules.detect_one(getattr(t, source)(), rule.name)


for _rule in rules.RULES:
    _register_rule(_rule)


@query("anomalies_all", "select seq, rule_ord, vehicle_id, anomaly_type, detail, detected_at from fired_fast")
def anomalies_all(t):
    """All rules on readings, without the sweeps."""
    return rules.detect(t.telemetry_fast())


@query("anomalies_with_silences", "select seq, rule_ord, vehicle_id, anomaly_type, detail, detected_at from anomalies_fast")
def anomalies_with_silences(t):
    return anomaly_table_fast(t)


@query("anomaly_counts_by_type", "select anomaly_type, count(*) as n from anomalies_fast group by 1")
def anomaly_counts_by_type(t):
    return anomalies.counts_by_type(anomaly_table_fast(t))


@query("anomaly_counts_by_vehicle", "select vehicle_id, anomaly_type, count(*) as n from anomalies_fast group by 1, 2")
def anomaly_counts_by_vehicle(t):
    return anomalies.counts_by_type(anomaly_table_fast(t), "vehicle_id", "anomaly_type")


@query("latest_anomaly_per_vehicle", "select vehicle_id, anomaly_type, detail, detected_at from latest_anomaly")
def latest_anomaly_per_vehicle(t):
    return anomalies.latest_per_vehicle(anomaly_table(t))


@query("recent_anomalies", """
select vehicle_id, anomaly_type, detail, detected_at from anomalies
where vehicle_id='v-3' and detected_at between timestamp '2024-01-05' and timestamp '2024-01-20'
order by detected_at, seq, rule_ord""")
def recent_anomalies(t):
    return anomalies.recent(anomaly_table(t), "v-3", "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z")


# Parameters as callers send them, by vehicle number; some are to be rejected.
_SINCE = "case when {u} % 7 = 3 then 'soon' when {u} % 2 = 0 then '2024-01-05T00:00:00Z' else '2024-01-10' end"
_UNTIL = "case when {u} % 11 = 5 then '' else '2024-01-20T12:30:00Z' end"


@query("recent_anomalies_tabular", """
select p.user_id as query_id, seq, rule_ord, a.vehicle_id, anomaly_type, detail, detected_at
from (select distinct user_id from events) p join anomalies a on a.vehicle_id = 'v-' || cast(p.user_id as varchar)
where p.user_id%10<>9 and p.user_id%7<>3 and p.user_id%11<>5
  and detected_at between case when p.user_id%2=0 then timestamp '2024-01-05' else timestamp '2024-01-10' end and timestamp '2024-01-20 12:30:00'""")
def recent_anomalies_tabular(t):
    """One query per vehicle, given as a table of parameters as text."""
    users = t.events().select("user_id").distinct()
    parameters = users.selectExpr(
        "user_id as query_id", "case when user_id % 10 = 9 then '' else concat('v-', cast(user_id as string)) end as vehicle_id",
        f"{_SINCE.format(u='user_id')} as since", f"{_UNTIL.format(u='user_id')} as until")
    return anomalies.recent_for(anomaly_table(t), parameters)


@query("stuck_dwell", """
select vehicle_id, min_by(recorded_at, seq) as run_start, max_by(recorded_at, seq) as run_end, count(*) as readings,
  (epoch_us(max_by(recorded_at, seq))-epoch_us(min_by(recorded_at, seq)))/1000000.0::double as dwell_s
from (select *, sum(case when slow then 0 else 1 end) over (partition by vehicle_id order by seq) as run from (
        select *, status='moving' and speed_mps<0.1 as slow from fast))
where slow group by vehicle_id, run
having (epoch_us(max_by(recorded_at, seq))-epoch_us(min_by(recorded_at, seq)))/1000000.0>=10""")
def stuck_dwell(t):
    return comms.stuck_dwell(t.telemetry_fast())


@query("comms_loss_episodes", """
select seq, vehicle_id, 'comms_loss' as anomaly_type, 'no event for over 5s' as detail, detected_at from episodes""")
def comms_loss_episodes(t):
    return comms.episodes(t.telemetry_fast(), instant(HORIZON))


@query("comms_loss_sweep", """
select l.vehicle_id, 'comms_loss' as anomaly_type, 'no event for over 5s' as detail,
  timestamp '2024-01-01 00:12:00' as detected_at
from last_fast l where l.recorded_at < timestamp '2024-01-01 00:11:55' and not exists (
  select 1 from episodes e where e.vehicle_id=l.vehicle_id and e.detected_at >= l.recorded_at
    and e.detected_at <= timestamp '2024-01-01 00:11:50')""")
def comms_loss_sweep(t):
    """A sweep at the end of the log, where sweeps ran until ten seconds before."""
    telemetry = t.telemetry_fast()
    flagged = comms.episodes(telemetry, instant("2024-01-01 00:11:50"))
    return comms.sweep(state.current_state(telemetry), flagged, instant(HORIZON))

"""Queries: status commands, missions, maintenance records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import faults
from .registry import query


def _moves(t):
    return faults.transitions(faults.outcomes(t.status_updates(), t.vehicles()))


@query("status_update_outcomes", "select seq, vehicle_id, status, reason, prior_status, outcome from resolved")
def status_update_outcomes(t):
    return faults.outcomes(t.status_updates(), t.vehicles())


@query("fault_transitions", "select seq, vehicle_id, prior_status, reason from moves")
def fault_transitions(t):
    return _moves(t)


@query("missions_after_faults", """
select mission_id, vehicle_id, case when status='active' and vehicle_id in (select vehicle_id from moves)
  then 'cancelled' else status end as status from missions""")
def missions_after_faults(t):
    return faults.missions_after(t.missions(), _moves(t)).select("mission_id", "vehicle_id", "status")


@query("fault_maintenance_records", """
select f.vehicle_id, m.mission_id, f.reason, f.seq as opened_seq from first_moves f
left join missions m on m.vehicle_id=f.vehicle_id and m.status='active'
where f.vehicle_id not in (select vehicle_id from open_records)""")
def fault_maintenance_records(t):
    return faults.maintenance_opened(_moves(t), t.missions(), t.open_records())


@query("vehicles_after_commands", """
select v.vehicle_id, coalesce(c.status, v.status) as status from vehicles v left join (
  select * from status_updates qualify row_number() over (partition by vehicle_id order by seq desc)=1) c
on c.vehicle_id=v.vehicle_id""")
def vehicles_after_commands(t):
    return faults.vehicles_after(t.status_updates(), t.vehicles())


@query("integrity_violations", """
select 'one_active_mission' as rule, 'v-' || cast(o_custkey as varchar) as vehicle_id, count(*) as n
from orders where o_orderstatus='O' group by 1, 2 having count(*)>1
union all
select 'one_open_record', vehicle_id, count(*) from maintenance_records where resolved_at is null group by 1, 2 having count(*)>1""")
def integrity_violations(t):
    return faults.integrity_violations(t.missions_unchecked(), t.maintenance_records())


@query("mission_status_counts", "select vehicle_id, status, count(*) as n from missions group by 1, 2")
def mission_status_counts(t):
    return faults.mission_counts(t.missions())


@query("maintenance_per_vehicle", """
select vehicle_id, count(*) as records, count(*) filter (resolved_at is null) as open_records,
  count(*) filter (resolved_at is not null) as resolved_records from maintenance_records group by 1""")
def maintenance_per_vehicle(t):
    return faults.maintenance_counts(t.maintenance_records())

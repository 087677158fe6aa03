"""Anomaly rules as SQL expressions, and a registry to add more."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from ..config import SkewPolicy, Thresholds
from ..functions import fixed3_text_sql, float_text_sql
from .skew import HotKeys
from .state import with_prior

NO_NUMBER, NO_TEXT = "cast(null as double)", "cast(null as string)"


@dataclass(frozen=True)
class Rule:
    """When a reading is an anomaly, and how to describe it.

    ``fires`` is SQL over a reading, with thresholds named in braces. Besides the reading's own
    columns there are ``prior_*`` (the previous reading), ``gap_s`` (seconds since it) and
    ``implied_mps`` (straight-line speed from its position). A stateful rule is not evaluated on
    a vehicle's first reading.

    ``x``, ``y`` and ``note`` are SQL for up to two numbers and a text to describe it by, and
    ``detail`` is SQL over these and over ``a`` and ``b``, the shortest text of ``x`` and ``y``.
    Keeping the numbers apart means text is made for fired rules only, and that the number
    formatting is generated once instead of once per rule. ``seq`` and ``at`` are SQL for the reading
    the anomaly belongs to and the instant it was detected.
    """

    name: str
    stateful: bool
    fires: str
    x: str = NO_NUMBER
    y: str = NO_NUMBER
    note: str = NO_TEXT
    detail: str = NO_TEXT
    seq: str = "seq"
    at: str = "recorded_at"

    def condition(self, t: Thresholds) -> str:
        holds = self.fires.format(**asdict(t))
        return f"(prior_seq is not null and {holds})" if self.stateful else f"({holds})"


# In the order their anomalies are written for one reading.
RULES: tuple[Rule, ...] = (
    Rule("fault_status", False, "status = 'fault'"),
    Rule("error_codes", False, "size(coalesce(error_codes, array())) > 0",
         note="array_join(error_codes, ',')", detail="note"),
    Rule("low_battery", False, "battery_pct < {low_battery_pct} and status <> 'charging'",
         x="battery_pct", detail="concat('battery_pct=', a)"),
    Rule("overspeed", False, "speed_mps > {overspeed_mps}", x="speed_mps", detail="concat('speed_mps=', a)"),
    Rule("stuck", True,
         "prior_status = 'moving' and prior_speed_mps < {stuck_mps}"
         " and status = 'moving' and speed_mps < {stuck_mps} and gap_s >= {stuck_seconds}",
         x="speed_mps", y="gap_s", detail="concat('speed_mps=', a, ', dt=', b, 's')"),
    Rule("teleport", True, "implied_mps > {teleport_mps}",
         x="implied_mps", detail=f"concat('implied_mps=', {fixed3_text_sql('x')})"),
    Rule("battery_rising", True, "battery_pct > prior_battery_pct and status <> 'charging'",
         x="prior_battery_pct", y="battery_pct", detail="concat(a, ' -> ', b)"),
)


def rule_named(name: str, rules: Sequence[Rule] = RULES) -> Rule:
    return next(r for r in rules if r.name == name)


def with_motion(readings: DataFrame) -> DataFrame:
    """Add ``gap_s`` and ``implied_mps``; the speed is null unless time advanced and both positions are known."""
    gap = "(unix_micros(recorded_at) - unix_micros(prior_recorded_at)) / 1e6D"
    return readings.selectExpr("*", f"{gap} as gap_s").selectExpr(
        "*", "case when gap_s > 0 then hypot(pos_x - prior_pos_x, pos_y - prior_pos_y) / gap_s end as implied_mps")


def _ready(readings: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return with_motion(readings) if any(r.stateful for r in rules) else readings


def _described(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows (seq, vehicle_id, at, rule_ord, x, y, note) to anomalies."""
    texts = hits.selectExpr(
        "*", f"{float_text_sql('x')} as a", f"{float_text_sql('y')} as b")
    choose = lambda part: "case rule_ord " + " ".join(
        f"when {i} then {part(r)}" for i, r in enumerate(rules)) + " end"
    return texts.selectExpr(
        "seq", "rule_ord", "vehicle_id", choose(lambda r: f"'{r.name}'") + " as anomaly_type",
        choose(lambda r: r.detail) + " as detail", "at as detected_at")


def fired(readings: DataFrame, rules: Sequence[Rule] = RULES, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row per fired rule, from readings that already carry ``prior_*`` if a rule is stateful."""
    hits = ", ".join(
        f"case when {r.condition(thresholds)} then named_struct("
        f"'rule_ord', {i}, 'x', {r.x}, 'y', {r.y}, 'note', {r.note}, 'seq', {r.seq}, 'at', {r.at}) end"
        for i, r in enumerate(rules)
    )
    # explode then filter: both stay in generated code, a higher-order filter would not
    one_each = _ready(readings, rules).selectExpr("vehicle_id", f"explode(array({hits})) as hit")
    return _described(one_each.filter("hit is not null").selectExpr("vehicle_id", "hit.*"), rules)


def fired_single(readings: DataFrame, rule: Rule, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Like :func:`fired` for one rule, as a plain filter the scan can take over."""
    hits = _ready(readings, [rule]).filter(rule.condition(thresholds)).selectExpr(
        f"{rule.seq} as seq", "vehicle_id", f"{rule.at} as at", "0 as rule_ord", f"{rule.x} as x", f"{rule.y} as y", f"{rule.note} as note")
    return _described(hits, [rule]).select("seq", "vehicle_id", "detail", "detected_at")


def detect(telemetry: DataFrame, rules: Sequence[Rule] = RULES, thresholds: Thresholds = Thresholds(),
           hot: HotKeys | None = None, policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """All anomalies of a telemetry log. No shuffle at all if every rule is stateless."""
    stateful = any(r.stateful for r in rules)
    return fired(with_prior(telemetry, hot, policy) if stateful else telemetry, rules, thresholds)


def detect_one(telemetry: DataFrame, name: str, thresholds: Thresholds = Thresholds(),
               policy: SkewPolicy = SkewPolicy(), rules: Sequence[Rule] = RULES) -> DataFrame:
    rule = rule_named(name, rules)
    return fired_single(with_prior(telemetry, policy=policy) if rule.stateful else telemetry, rule, thresholds)

"""Rules by absence and by duration: lost communication, and vehicles that dwell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SkewPolicy, Thresholds
from ..functions import first_tick_after, from_micros, micros, seconds_between
from .rules import RULES, Rule, fired
from .skew import find_hot_keys, with_neighbour, with_running_sum
from .state import with_prior

COMMS_LOSS = "comms_loss"


def comms_loss_detail(t: Thresholds) -> Column:
    return F.lit(f"no event for over {t.comms_loss_seconds}s")


def sweep(state: DataFrame, anomalies: DataFrame, now: Column, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Vehicles newly found silent at ``now``.

    Silent means the last reading is strictly older than the timeout and no comms_loss is
    recorded at or after it. Only the newest comms_loss of a vehicle can matter, so the
    anomalies shrink to one row per vehicle before the join.
    """
    limit_us = micros(now) - F.lit(int(thresholds.comms_loss_seconds * 1_000_000))
    known = anomalies.filter(F.col("anomaly_type") == COMMS_LOSS).groupBy("vehicle_id").agg(
        F.max("detected_at").alias("flagged_at"))
    silent = state.filter(micros(F.col("recorded_at")) < limit_us)
    still_open = silent.join(
        known, (silent["vehicle_id"] == known["vehicle_id"]) & (known["flagged_at"] >= silent["recorded_at"]),
        "left_anti")
    return still_open.select(
        "vehicle_id", F.lit(COMMS_LOSS).alias("anomaly_type"), comms_loss_detail(thresholds).alias("detail"),
        now.alias("detected_at"))


def episodes(telemetry: DataFrame, until: Column, thresholds: Thresholds = Thresholds(),
             policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """What a sweep on every whole second up to ``until`` would have flagged over the log.

    A reading is taken to arrive at its recorded time. It opens an episode if a sweep falls
    after its timeout and before the vehicle's next reading.
    """
    hot = find_hot_keys(telemetry, "vehicle_id", policy=policy)
    rows = with_neighbour(
        telemetry.select("seq", "vehicle_id", "recorded_at"), hot, ["seq"], ["recorded_at"], "next",
        following=True, policy=policy)
    tick = first_tick_after(F.col("recorded_at"), thresholds.comms_loss_seconds)
    heard_again = micros(F.col("next_recorded_at"))
    missed = (tick <= micros(until)) & (F.col("next_seq").isNull() | (tick < heard_again))
    return rows.filter(missed).select(
        "seq", "vehicle_id", F.lit(COMMS_LOSS).alias("anomaly_type"),
        comms_loss_detail(thresholds).alias("detail"), from_micros(tick).alias("detected_at"))


def ended_silence(t: Thresholds) -> Rule:
    """A silence as a rule of the reading that ended it: it belongs to the reading before, at the tick that found it.

    ``sweeps_until`` must be a column of the readings: the instant up to which sweeps ran.
    """
    tick = f"timestamp_micros((floor((unix_micros(prior_recorded_at) + {t.comms_loss_seconds} * 1000000L) / 1000000) + 1) * 1000000)"
    return Rule(COMMS_LOSS, True, f"{tick} < recorded_at and {tick} <= sweeps_until",
                detail=f"'no event for over {t.comms_loss_seconds}s'", seq="prior_seq", at=tick)


def lasting_silences(telemetry: DataFrame, until: Column, rule_ord: int = len(RULES), thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Silences up to ``until`` that no reading has ended: at most one per vehicle, from its last reading."""
    last = telemetry.groupBy("vehicle_id").agg(F.max("seq").alias("seq"), F.max_by("recorded_at", "seq").alias("recorded_at"))
    tick = first_tick_after(F.col("recorded_at"), thresholds.comms_loss_seconds)
    return last.filter(tick <= micros(until)).select(
        "seq", F.lit(rule_ord).cast("int").alias("rule_ord"), "vehicle_id", F.lit(COMMS_LOSS).alias("anomaly_type"),
        comms_loss_detail(thresholds).alias("detail"), from_micros(tick).alias("detected_at"))


def all_anomalies(telemetry: DataFrame, until: Column, rules: Sequence[Rule] = RULES,
                  thresholds: Thresholds = Thresholds(), policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """The anomalies table: what the rules found, and the silences flagged up to ``until``.

    An episode of silence has the ``seq`` of the last reading before it, and stands after all rules of that reading. Since it
    is flagged before the vehicle's next reading, (seq, rule_ord) stays the order in which a vehicle's anomalies came up.
    Rules and silences look at the same previous reading, so the log is shuffled by vehicle once.
    """
    readings = with_prior(telemetry, policy=policy).withColumn("sweeps_until", until.cast("timestamp"))
    found = fired(readings, [*rules, ended_silence(thresholds)], thresholds)
    return found.unionByName(lasting_silences(telemetry, until, len(rules), thresholds))


def stuck_dwell(telemetry: DataFrame, thresholds: Thresholds = Thresholds(),
                policy: SkewPolicy = SkewPolicy()) -> DataFrame:
    """Unbroken runs of readings that are moving yet stationary, lasting at least the dwell time.

    Unlike the ``stuck`` rule, which compares two adjacent readings, this measures the run.
    """
    slow = (F.col("status") == "moving") & (F.col("speed_mps") < thresholds.stuck_mps)
    readings = telemetry.select("seq", "vehicle_id", "recorded_at", slow.alias("slow"))
    hot = find_hot_keys(telemetry, "vehicle_id", policy=policy)
    # rows of one run share the number of readings that were not slow before them
    numbered = with_running_sum(readings, hot, ["seq"], F.when(F.col("slow"), 0).otherwise(1), "run", policy=policy)
    runs = numbered.filter("slow").groupBy("vehicle_id", "run").agg(
        F.min_by("recorded_at", "seq").alias("run_start"), F.max_by("recorded_at", "seq").alias("run_end"),
        F.count(F.lit(1)).alias("readings"))
    dwell = seconds_between(F.col("run_end"), F.col("run_start"))
    return runs.withColumn("dwell_s", dwell).filter(F.col("dwell_s") >= thresholds.stuck_seconds).drop("run")

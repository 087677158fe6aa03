"""Validation of readings and status commands: accepted rows, or the first reason to reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BATTERY_RANGE, STATUSES, VEHICLE_ID_MAX
from ..functions import evaluated_once
from ..schemas import STATUS_UPDATE_FIELDS, TELEMETRY, TELEMETRY_FIELDS

REASON = "reject_reason"


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNull()).drop(REASON)


def rejected(df: DataFrame) -> DataFrame:
    return df.filter(F.col(REASON).isNotNull())


def reject_counts(df: DataFrame) -> DataFrame:
    return rejected(df).groupBy(REASON).agg(F.count(F.lit(1)).alias("n"))


def _first_reason(checks: list[tuple[Column, str]]) -> Column:
    """The name of the first check that holds; a check that is null does not."""
    reason = F.when(checks[0][0], checks[0][1])
    for failed, name in checks[1:]:
        reason = reason.when(failed, name)
    return reason


def _value_checks() -> list[tuple[Column, str]]:
    vehicle, battery, speed = F.col("vehicle_id"), F.col("battery_pct"), F.col("speed_mps")
    low, high = BATTERY_RANGE
    return [
        (vehicle.isNull(), "vehicle_id_missing"),
        (~F.char_length(vehicle).between(1, VEHICLE_ID_MAX), "vehicle_id_length"),
        (F.col("status").isNull(), "status_missing"),
        (~F.col("status").isin(*STATUSES), "status_unknown"),
        (battery.isNull(), "battery_pct_missing"),
        # Spark orders NaN above every number, so the upper bound alone would catch it; be plain.
        (F.isnan(battery) | ~battery.between(low, high), "battery_pct_range"),
        (F.isnan(speed) | (speed < 0), "speed_mps_range"),
    ]


def validate_readings(telemetry: DataFrame) -> DataFrame:
    """Already typed readings plus ``reject_reason``."""
    optional = [
        (F.col("recorded_at").isNull(), "recorded_at_type"),
        (F.col("speed_mps").isNull(), "speed_mps_type"),
        (F.col("error_codes").isNull(), "error_codes_type"),
    ]
    return telemetry.withColumn(REASON, _first_reason(_value_checks() + optional))


# A JSON object is opened once, into ``_body``, and the type of each member is looked up once,
# into ``_kind``: null if the key is missing, ``VOID`` for an explicit null.

def _get(name: str, as_type: str) -> Column:
    return F.try_variant_get("_body", f"$.{name}", as_type)


def _kind(name: str) -> Column:
    return F.col(f"_kind.{name}")


def _open_body(bodies: DataFrame, names: tuple[str, ...]) -> DataFrame:
    opened = evaluated_once(bodies, "_body", F.try_parse_json("raw"))
    is_object = F.schema_of_variant("_body").startswith("OBJECT")
    opened = opened.withColumn("_body", F.when(is_object, F.col("_body")))
    kinds = [F.schema_of_variant(_get(n, "variant")).alias(n) for n in names]
    return opened.withColumn("_kind", F.struct(*kinds))


def _is_number(name: str) -> Column:
    return _kind(name).isin("BIGINT", "DOUBLE", "FLOAT") | _kind(name).startswith("DECIMAL")


def _text(name: str) -> Column:
    return F.when(_kind(name) == "STRING", _get(name, "string"))


def _number(name: str) -> Column:
    """Numbers, booleans, and text that reads as a number."""
    direct = _is_number(name) | (_kind(name) == "BOOLEAN")
    return F.when(direct, _get(name, "double")).when(
        _kind(name) == "STRING", _get(name, "string").try_cast("double"))


UNIX_RANGE = (-62_135_596_800.0, 253_402_300_799.0)  # years 1 to 9999, in seconds


def _instant(name: str) -> Column:
    """ISO-8601 text (UTC unless it names a zone), or unix seconds or milliseconds; years 1 to 9999."""
    text, number = _get(name, "string"), _get(name, "double")
    iso = r"^(?!0000)\d{4}-\d{2}-\d{2}([Tt_ ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s*([Zz]|[+-]\d{2}:?\d{2})?)?$"
    seconds = F.when(F.abs(number) > 2e10, number / 1000).otherwise(number)
    return F.when(
        (_kind(name) == "STRING") & text.rlike(iso), F.translate(text, "t_z,", "TTZ.").try_cast("timestamp"),
    ).when(_is_number(name) & seconds.between(*UNIX_RANGE), F.timestamp_micros(F.round(seconds * 1e6).try_cast("long")))


def _wrong(name: str, nullable: bool) -> Column:
    """Present but not convertible; an explicit null is wrong unless the field is optional."""
    bad = _kind(name).isNotNull() & F.col(name).isNull()
    return bad & (_kind(name) != "VOID") if nullable else bad


def _with_reason(typed: DataFrame, checks: list[tuple[Column, str]], names: list[str]) -> DataFrame:
    row = F.struct(*names, _first_reason(checks).alias(REASON))
    return evaluated_once(typed, "_row", row).select("_row.*")


def unknown_fields(body: Column, allowed: tuple[str, ...]) -> Column:
    """The keys of a parsed object that are not in ``allowed``, in the order of their names."""
    keys = F.map_keys(F.try_variant_get(body, "$", "map<string,variant>"))
    return F.array_sort(F.array_except(keys, F.array(*[F.lit(name) for name in allowed])))


def parse_readings(bodies: DataFrame) -> DataFrame:
    """Request bodies (seq, raw, ingest_ts) to typed readings plus ``reject_reason``.

    Defaults apply to missing keys only; ``ingest_ts`` is the clock for ``recorded_at``.
    """
    missing = lambda name: _kind(name).isNull()
    codes = _get("error_codes", "array<string>")
    plain_codes = _kind("error_codes").isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(codes, F.isnull)
    columns = {
        "vehicle_id": _text("vehicle_id"),
        "status": _text("status"),
        "battery_pct": _number("battery_pct"),
        "recorded_at": F.when(missing("recorded_at"), F.col("ingest_ts")).otherwise(_instant("recorded_at")),
        "zone_entered": _text("zone_entered"),
        "speed_mps": F.when(missing("speed_mps"), 0.0).otherwise(_number("speed_mps")),
        "error_codes": F.when(missing("error_codes"), F.array().cast("array<string>")).when(plain_codes, codes),
        "pos_x": _number("pos_x"),
        "pos_y": _number("pos_y"),
    }
    nullable = {"zone_entered", "pos_x", "pos_y"}
    typed = _open_body(bodies, TELEMETRY_FIELDS).withColumns(columns)
    checks = [
        (F.col("_body").isNull(), "malformed_body"),
        (F.size(unknown_fields(F.col("_body"), TELEMETRY_FIELDS)) > 0, "unknown_field"),
        *[(_wrong(n, n in nullable), f"{n}_type") for n in columns],
        *_value_checks(),
    ]
    return _with_reason(typed, checks, TELEMETRY.names)


def parse_status_updates(bodies: DataFrame) -> DataFrame:
    """Command bodies (seq, vehicle_id from the path, raw) to typed commands plus ``reject_reason``."""
    parsed = _open_body(bodies, STATUS_UPDATE_FIELDS).withColumns({
        "status": _text("status"), "reason": _text("reason"),
    })
    checks = [
        (F.col("_body").isNull(), "malformed_body"),
        (F.size(unknown_fields(F.col("_body"), STATUS_UPDATE_FIELDS)) > 0, "unknown_field"),
        (_wrong("status", False), "status_type"),
        (_wrong("reason", True), "reason_type"),
        (F.col("status").isNull(), "status_missing"),
        (~F.col("status").isin(*STATUSES), "status_unknown"),
    ]
    return _with_reason(parsed, checks, ["seq", "vehicle_id", "status", "reason"])

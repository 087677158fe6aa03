"""Telemetry-shaped views over the generic test tables (``events`` and ``orders``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FEED_TYPES, ZONES
from ..operators.metrics import counter_samples
from ..session import pin_utc

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01, where the events begin
SPEEDUP = 3600  # telemetry_fast: hours between readings become seconds

def k() -> Column:
    """The number each event carries: 0 to 99, it decides what the event becomes."""
    return F.col("k")


def vehicle_name(number: Column) -> Column:
    return F.concat(F.lit("v-"), number.cast("string"))


class DriverTables:
    """Lazily built views; each method returns a fresh DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        pin_utc(spark)
        self.spark, self.dir = spark, sf_dir

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def events(self) -> DataFrame:
        return self._read("events").selectExpr(
            "event_id", "user_id", "event_type", "value", "cast(ts as timestamp) as ts",
            "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k")

    def telemetry(self) -> DataFrame:
        return self._telemetry("cast(k as double)")

    def telemetry_dirty(self) -> DataFrame:
        """Typed readings whose battery is ``value``, hence often over 100."""
        return self._telemetry("value")

    def _telemetry(self, battery: str) -> DataFrame:
        # place 0..18 is a zone, 19 an unknown one, 20..24 none
        names = ", ".join(f"'{z}'" for z in (*ZONES[:19], "zone-07"))
        return self.events().selectExpr(
            "event_id as seq",
            "concat('v-', cast(user_id as string)) as vehicle_id",
            """case when event_type in ('view', 'click') then 'moving' when event_type = 'error' and k % 2 = 0 then 'fault'
                 when event_type = 'error' then 'moving' when event_type = 'purchase' then 'charging'
                 else 'idle' end as status""",
            f"{battery} as battery_pct",
            "ts as recorded_at",
            f"get(array({names}), cast(event_id % 25 as int)) as zone_entered",
            "case when k % 4 = 1 then 0.0625D else k / 16D end as speed_mps",
            """case when event_type = 'error' then array(concat('E', cast(k as string)))
                 else cast(array() as array<string>) end as error_codes""",
            "case when k % 10 <> 9 then cast(k as double) * 10000 end as pos_x",
            "value * 1000 as pos_y",
        )

    def telemetry_fast(self) -> DataFrame:
        """Time and position compressed alike, so that rules with a time bound matter."""
        us = f"{EPOCH_US} + floor((unix_micros(recorded_at) - {EPOCH_US}) / {SPEEDUP})"
        moved = {
            "recorded_at": f"timestamp_micros({us})", "pos_x": f"pos_x / {SPEEDUP}", "pos_y": f"pos_y / {SPEEDUP}",
        }
        plain = self.telemetry()
        return plain.selectExpr(*[f"{moved.get(c, c)} as {c}" for c in plain.columns])

    def telemetry_delayed(self) -> DataFrame:
        """The same readings, every seventh one arriving 1500 events late."""
        delay = F.when(F.col("seq") % 7 == 3, F.lit(3001)).otherwise(F.lit(0))
        return self.telemetry().withColumn("seq", F.col("seq") * 2 + delay)

    def telemetry_json(self) -> DataFrame:
        """Request bodies, some of them wrong in one of several ways chosen by ``k``."""
        def key(name: str, value: Column, unless: Column | None = None) -> Column:
            pair = F.concat(F.lit(f'"{name}":'), value)
            return pair if unless is None else F.when(~unless, pair)

        def quoted(value: Column) -> Column:
            return F.concat(F.lit('"'), value, F.lit('"'))

        case = k() % 20
        body = F.concat_ws(
            ",",
            key("vehicle_id", quoted(F.when(case == 2, "").otherwise(vehicle_name(F.col("user_id")))), case == 7),
            key("status", quoted(F.when(case == 3, "flying").otherwise("moving"))),
            key("battery_pct", F.col("value").cast("string"), case == 1),
            key("speed_mps", F.when(case == 4, "-1.0").when(case == 6, "null").otherwise("2.5"), case == 5),
            F.when(case == 0, F.lit('"firmware":"1.2"')),
            F.when(case == 8, F.lit('"error_codes":["E1","E2"]')),
        )
        raw = F.concat(F.lit("{"), body, F.when(case != 9, "}").otherwise(""))
        return self.events().select(F.col("event_id").alias("seq"), raw.alias("raw"), F.col("ts").alias("ingest_ts"))

    def vehicles(self) -> DataFrame:
        code = F.col("user_id") % 4
        return (
            self._read("events").filter(F.col("user_id") % 10 != 9).select("user_id").distinct()
            .select(
                vehicle_name(F.col("user_id")).alias("vehicle_id"),
                F.when(code == 0, "idle").when(code == 1, "moving").when(code == 2, "charging")
                .otherwise("fault").alias("status"),
            )
        )

    def missions(self) -> DataFrame:
        orders = self._read("orders").select("o_orderkey", "o_custkey")
        newest = (
            orders.filter(F.col("o_custkey") % 3 != 0).groupBy("o_custkey")
            .agg(F.max("o_orderkey").alias("o_orderkey")).select("o_orderkey", F.lit(True).alias("newest"))
        )
        # joined on the order key, which is unique, so a customer with many orders does no harm
        return orders.join(newest, "o_orderkey", "left").select(
            F.col("o_orderkey").alias("mission_id"),
            vehicle_name(F.col("o_custkey")).alias("vehicle_id"),
            F.when(F.col("newest"), "active").otherwise("completed").alias("status"),
        )

    def missions_unchecked(self) -> DataFrame:
        """Every open order as an active mission: breaks the one-active rule on purpose."""
        return self._read("orders").select(
            F.col("o_orderkey").alias("mission_id"), vehicle_name(F.col("o_custkey")).alias("vehicle_id"),
            F.when(F.col("o_orderstatus") == "O", "active").otherwise("completed").alias("status"),
        )

    def open_records(self) -> DataFrame:
        return (
            self._read("events").filter(F.col("user_id") % 7 == 3).select("user_id").distinct()
            .select(vehicle_name(F.col("user_id")).alias("vehicle_id"))
        )

    def maintenance_records(self) -> DataFrame:
        """A record per error event, the even ones resolved after an hour."""
        e = self.events().filter(F.col("event_type") == "error")
        return e.select(
            F.col("event_id").alias("id"), vehicle_name(F.col("user_id")).alias("vehicle_id"),
            F.lit(None).cast("long").alias("mission_id"), F.concat(F.lit("E"), k().cast("string")).alias("reason"),
            F.col("ts").alias("opened_at"),
            F.when(k() % 2 == 0, F.col("ts") + F.expr("interval 1 hour")).alias("resolved_at"),
        )

    def status_updates(self) -> DataFrame:
        kind = F.col("event_type")
        e = self.events().filter(kind.isin("error", "signup", "purchase"))
        return e.select(
            F.col("event_id").alias("seq"), vehicle_name(F.col("user_id")).alias("vehicle_id"),
            F.when(kind == "error", "fault").when(kind == "signup", "idle").otherwise("charging").alias("status"),
            F.when(kind == "error", F.concat(F.lit("E"), k().cast("string"))).alias("reason"),
        )

    def status_updates_json(self) -> DataFrame:
        """Command bodies: unknown status, unknown key and broken text chosen by ``k``."""
        case = k() % 10
        raw = (
            F.when(case == 0, F.lit('{"status":"flying"}'))
            .when(case == 1, F.lit('{"status":"idle","note":"x"}'))
            .when(case == 2, F.lit('{"reason":"E1"}'))
            .when(case == 3, F.lit('["fault"]'))
            .when(case == 4, F.lit('{"status":"fault","reason":null}'))
            .otherwise(F.concat(F.lit('{"status":"fault","reason":"E'), k().cast("string"), F.lit('"}')))
        )
        return self.events().select(
            F.col("event_id").alias("seq"), vehicle_name(F.col("user_id")).alias("vehicle_id"), raw.alias("raw"))

    def requests(self) -> DataFrame:
        return self._requests(F.concat(F.lit("/"), F.col("event_type")))

    def requests_unrouted(self) -> DataFrame:
        """Requests with their path, some of which matched no route."""
        path = F.concat(F.lit("/"), F.col("event_type"))
        return self._requests(F.when(k() % 13 != 0, path), path.alias("path"))

    def _requests(self, route: Column, *more: Column) -> DataFrame:
        code = F.when(k() < 3, 422).when(k() < 5, 404).when(k() < 6, 500).otherwise(201)
        return self.events().select(
            "ts", F.lit("POST").alias("method"), route.alias("route"), code.alias("status_code"),
            F.col("value").alias("duration_ms"), *more,
        )

    def decode_samples(self) -> DataFrame:
        """Milliseconds from decoding a change to publishing it, per feed type."""
        kind = F.element_at(F.array(*[F.lit(x) for x in FEED_TYPES]), (k() % 3 + 1).cast("int"))
        return self.events().select("ts", kind.alias("type"), (F.col("value") / 8).alias("lag_ms"))

    def metric_samples(self) -> DataFrame:
        """Requests so far per route, sampled each minute; the counter restarts every day."""
        return counter_samples(self.requests(), "route", "requests_total")

    def connections(self) -> DataFrame:
        """A gauge per route: requests in flight, taken as those of the same minute."""
        per_minute = self.requests().groupBy(F.date_trunc("minute", "ts").alias("ts"), "route")
        return per_minute.agg(F.count(F.lit(1)).alias("value"))

    def feed_messages(self) -> DataFrame:
        """State patches as received, some of them broken in ways chosen by ``k``."""
        case = k() % 12
        body = F.concat(
            F.lit('{"vehicle_id":"'), vehicle_name(F.col("user_id")), F.lit('","status":"moving","battery_pct":'),
            F.col("value").cast("string"), F.lit("}"))
        head = F.lit('{"type":"vehicle_state_changed","payload":')
        value = (
            F.when(case == 0, F.lit("not json"))
            .when(case == 1, F.concat(F.lit('{"type":"vehicle_deleted","payload":'), body, F.lit("}")))
            .when(case == 2, F.concat(head, F.lit("null}")))
            .when(case == 3, F.concat(head, F.lit("[1]}")))
            .when(case == 4, F.concat(head, F.lit('"{}"}')))
            .when(case == 5, F.concat(head, body, F.lit(',"_trace":{"traceparent":"00-1"}}')))
            .otherwise(F.concat(head, body, F.lit("}")))
        )
        return self.events().select(F.col("event_id").alias("seq"), F.lit(0).alias("slot"), value.alias("value"))

    def lag_samples(self) -> DataFrame:
        """Standby byte lag: blank and missing names, unreported lags."""
        return self.events().select(
            "ts",
            F.when(k() % 10 == 0, F.lit(None)).when(k() % 10 == 1, "")
            .otherwise(F.concat(F.lit("standby-"), (k() % 4).cast("string"))).alias("application_name"),
            F.when(k() % 5 != 4, F.floor(F.col("value") * 1000)).alias("lag_bytes"),
        )

    def replay_samples(self) -> DataFrame:
        """Replay time against the clock: behind, a little ahead, or none yet."""
        us = F.unix_micros("ts")
        return self.events().select(
            F.col("event_id").alias("seq"), F.col("ts").alias("now"),
            F.when(k() % 7 != 0, F.timestamp_micros(us - (k() - 5).cast("long") * 250_000)).alias("replay_ts"),
        )

    def spans(self) -> DataFrame:
        e = self.events().filter(k() % 11 != 0)
        place = F.col("event_id") % 4
        pick = lambda *names: F.when(place == 0, names[0]).when(place == 1, names[1]).when(
            place == 2, names[2]).otherwise(names[3])
        return e.select(
            (F.col("event_id") - place).alias("trace_id"),
            F.col("event_id").alias("span_id"),
            F.when(place > 0, F.col("event_id") - 1).alias("parent_span_id"),
            pick("browser", "frontend-api", "cdc-consumer", "frontend-api").alias("service"),
            pick("documentLoad", "HTTP GET", "cdc.publish", "frontend.subscribe").alias("name"),
            pick("CLIENT", "SERVER", "PRODUCER", "CONSUMER").alias("kind"),
            F.col("ts").alias("start_ts"),
            F.col("value").alias("duration_ms"),
            F.create_map(
                F.lit("http.method"), F.when(k() % 2 == 0, "GET").otherwise("POST"),
                F.lit("server.address"), F.when(k() % 3 == 0, "db-primary"),
            ).alias("attributes"),
        )

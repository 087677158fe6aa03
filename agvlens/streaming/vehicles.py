"""Vehicles in Spark's state store: the previous reading of each, and a timer for its silence.

Readings pass through with the reading before them, so no table of the fleet has to be read in a micro-batch. Vehicles are dealt into
``GROUPS`` groups by hash. A group's rows of a batch are put in order and shifted as numpy arrays, all its vehicles at once, since a call
for each vehicle costs far more than its rows; the state of a vehicle that has rows is read and written once. A vehicle is due at the first
whole second after the timeout of its last reading. A group keeps its vehicles by the second they are due, with one timer a second: the store
finds expired timers by their time, without passing over the fleet. A vehicle that has been heard since is still listed there, and passed over.

Time is the event time of a clock column that readings do not carry, so Spark drops no reading as late. Ticks (of a clock stream, or
the newest recorded time in a replay) move it. A silence is told with the second it began to be one, however late the batch
and however many ticks fell into it: by its timer, or by the next reading if that is there first.

With ``lateness`` the job runs on event time instead: the readings themselves move the clock, which stays ``lateness`` behind the newest;
readings it has passed are marked ``late``, second ones of the same vehicle and instant ``repeat``, and neither changes any state.

Pandas cannot tell null from NaN and has no null long, so numbers travel filled, with a bit for each null.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Thresholds
from ..operators.state import PRIOR
from ..schemas import TELEMETRY

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
READING, SILENCE, LATE, REPEAT = "reading", "silence", "late", "repeat"

_NUMBERS = ["battery_pct", "speed_mps", "pos_x", "pos_y"]
_TIME_BIT = 1 << len(_NUMBERS)
_CARRIED = ["seq", "us", "nulls", "status", *_NUMBERS]
GROUPS = 512  # fixed in a checkpoint
_STATE = "seq long, us long, nulls int, status string, battery_pct double, speed_mps double, pos_x double, pos_y double, told boolean, recent array<long>"
_ROW = ("seq long, us long, nulls int, status string, battery_pct double, speed_mps double, pos_x double, pos_y double, "
        "zone_entered string, error_codes array<string>")
_OUTPUT = (f"vehicle_id string, {_ROW}, fate string, silent_us long, has_prior boolean, "
           "p_seq long, p_us long, p_nulls int, p_status string, p_battery_pct double, p_speed_mps double, p_pos_x double, p_pos_y double")


def _tracker(timeout_us: int, by_readings: bool, state: str, carried: list[str], output: list[str], time_bit: int, words: tuple[str, ...]) -> StatefulProcessor:
    """The processor. Its class is local so that it travels by value: workers need not have this package."""
    import numpy as np
    import pandas as pd

    second, never = 1_000_000, 1 << 62
    reading, silence, late, repeat = words
    blank = {"string": None, "double": 0.0, "long": 0, "int": 0, "boolean": False}

    def deadlines(us, nulls):
        return np.where(nulls & time_bit, never, (us + timeout_us) // second * second + second)

    kinds = dict(c.split() for c in output)

    def filled(columns: dict, n: int) -> pd.DataFrame:
        return pd.DataFrame({c: columns[c] if c in columns else [None if kind.startswith("array") else blank[kind]] * n for c, kind in kinds.items()})

    def silences(vehicles, seqs, at) -> pd.DataFrame:
        return filled({"vehicle_id": vehicles, "seq": seqs, "silent_us": at, "fate": [silence] * len(vehicles)}, len(vehicles))

    class Tracker(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.last = handle, handle.getMapState("last", "vehicle_id string", state)
            self.due = handle.getMapState("due", "us long", "vehicles array<string>")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            parts = list(rows)
            frame = pd.concat(parts) if len(parts) > 1 else parts[0]
            numbers, vehicles = pd.factorize(frame["vehicle_id"], use_na_sentinel=False)
            vehicles = [None if pd.isna(v) else v for v in vehicles]
            order = np.lexsort((frame["seq"].to_numpy(), numbers))
            frame, numbers = frame.iloc[order], numbers[order]
            known = [self.last.getValue((v,)) for v in vehicles]
            recent = [[] if k is None else list(k[-1]) for k in known]
            clock_ms = timerValues.getCurrentWatermarkInMs()
            if by_readings:
                passed = clock_ms * 1000
                us, timed = frame["us"].to_numpy(), (frame["nulls"].to_numpy() & time_bit) == 0
                is_late = timed & (us <= passed) if passed > 0 else np.zeros(len(us), bool)
                recent = [[x for x in r if x > passed] for r in recent]
                seen = np.array([(i, x) for i, r in enumerate(recent) for x in r], np.int64).reshape(-1, 2)
                may = timed & ~is_late
                again = np.zeros(len(us), bool)
                again[may] = pd.DataFrame(np.concatenate([seen, np.column_stack([numbers[may], us[may]])])).duplicated().to_numpy()[len(seen):]
                refused = is_late | again
                if refused.any():
                    out = frame[refused]
                    yield filled({c: out[c].to_numpy() for c in kinds if c in out} | {"fate": np.where(is_late[refused], late, repeat)}, len(out))
                    frame, numbers = frame[~refused], numbers[~refused]
                    if not len(frame):
                        return
                timed = (frame["nulls"].to_numpy() & time_bit) == 0
                for i, x in zip(numbers[timed].tolist(), frame["us"].to_numpy()[timed].tolist(), strict=True):
                    recent[i].append(x)
            n, us, nulls = len(frame), frame["us"].to_numpy(), frame["nulls"].to_numpy()
            begins = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
            ends = np.r_[begins[1:], n] - 1
            there = numbers[begins].tolist()
            earlier = [known[i] for i in there]
            new = np.array([k is None for k in earlier])
            was_told = np.array([k is not None and k[-2] for k in earlier])
            before = {}
            for i, c in enumerate(carried):
                column = frame[c].to_numpy()
                before[c] = column[np.maximum(np.arange(n) - 1, 0)]
                before[c][begins] = [column[at] if k is None else k[i] for at, k in zip(begins, earlier, strict=True)]
            has_prior = np.ones(n, bool)
            has_prior[begins] = ~new
            due = deadlines(before["us"], before["nulls"])
            silent = has_prior & ((nulls & time_bit) == 0) & (due < us)
            silent[begins[was_told]] = False  # its timer has told
            yield filled({c: frame[c].to_numpy() for c in kinds if c in frame} | {f"p_{c}": v for c, v in before.items()}
                         | {"fate": [reading] * n, "has_prior": has_prior}, n)
            now, old = deadlines(us[ends], nulls[ends]), due[begins]
            timer = ~new & (old != never)
            # a silence that was told after the reading's own time covers it, as for a sweep that looks for one since then
            told = was_told & timer & (us[ends] <= old)
            waits = (now != never) & ~told & ~(timer & ~was_told & (old == now))
            over = waits & (now // 1000 < clock_ms)  # a timer would go off in this very batch
            ids = np.array(vehicles, object)
            if silent.any() or over.any():
                yield silences(np.r_[ids[numbers[silent]], ids[there][over]], np.r_[before["seq"][silent], frame["seq"].to_numpy()[ends][over]], np.r_[due[silent], now[over]])
            last = zip(*[frame[c].to_numpy()[ends].tolist() for c in carried], (told | over).tolist(), strict=True)
            for i, values in zip(there, last, strict=True):
                self.last.updateValue((vehicles[i],), (*values, recent[i]))
            for at in np.unique(now[waits & ~over]).tolist():
                listed = self.due.getValue((at,))
                if listed is None:
                    self.handle.registerTimer(at // 1000)
                self.due.updateValue((at,), ([*(listed[0] if listed else []), *ids[there][waits & ~over & (now == at)].tolist()],))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            own = expiredTimerInfo.getExpiryTimeInMs()
            if not self.due.containsKey((own * 1000,)):
                return  # another timer of the group went off before
            clock_ms, found = timerValues.getCurrentWatermarkInMs(), []
            for at in sorted(k[0] for k in self.due.keys() if k[0] // 1000 == own or k[0] // 1000 < clock_ms):
                for vehicle in self.due.getValue((at,))[0]:
                    known = tuple(self.last.getValue((vehicle,)))
                    due = int(deadlines(np.array([known[1]]), np.array([known[2]]))[0])
                    if due == at and not known[-2]:  # else a reading moved it
                        self.last.updateValue((vehicle,), (*known[:-2], True, list(known[-1])))
                        found.append((vehicle, known[0], at))
                self.due.removeKey((at,))
            if found:
                yield silences(*zip(*found, strict=True))

        def close(self) -> None:
            pass

    return Tracker()


def _packed(readings: DataFrame) -> DataFrame:
    """Readings as the processor takes them."""
    nulls = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate([*_NUMBERS, "recorded_at"])), F.lit(0))
    return readings.select(
        F.pmod(F.xxhash64("vehicle_id"), F.lit(GROUPS)).cast("int").alias("bucket"), "vehicle_id", "seq", F.coalesce(F.unix_micros("recorded_at"), F.lit(0)).alias("us"), nulls.cast("int").alias("nulls"), "status",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _NUMBERS], "zone_entered", "error_codes",
        F.lit(None).cast("timestamp").alias("clock"))


def _only_time(times: DataFrame, clock: Column) -> DataFrame:
    """Rows that move the clock and are nothing else. A timer goes off once the clock is past it, so one that stands on the tick waits for the millisecond after."""
    return times.filter(clock.isNotNull()).select((clock + F.expr("interval 1 millisecond")).alias("clock"))


def tracked(readings: DataFrame, ticks: DataFrame | None = None, thresholds: Thresholds = Thresholds(), lateness: str | None = None) -> DataFrame:
    """The stream of readings with ``prior_*``, and of the vehicles' silences (``fate``, ``silent_at``).

    ``ticks`` (column ``now``) are the clock; without any and without ``lateness``, a silence shows with the next reading only.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = _packed(readings)
    if lateness is not None:
        rows = rows.unionByName(_only_time(readings, F.col("recorded_at")), allowMissingColumns=True)
    if ticks is not None:
        rows = rows.unionByName(_only_time(ticks, F.col("now")), allowMissingColumns=True)
    rows = rows.withWatermark("clock", lateness or "0 seconds").filter("clock is null")  # rows of time alone have told it here
    timeout = int(thresholds.comms_loss_seconds * 1_000_000)
    processor = _tracker(timeout, lateness is not None, _STATE, _CARRIED, _OUTPUT.split(", "), _TIME_BIT, (READING, SILENCE, LATE, REPEAT))
    out = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=_OUTPUT, outputMode="Append", timeMode="EventTime")
    return _unpacked(out)


def _unpacked(out: DataFrame) -> DataFrame:
    def number(name: str, i: int, nulls: str) -> Column:
        # a value that is lost on the way without being null was NaN
        return F.when(F.getbit(nulls, F.lit(i)) == 0, F.coalesce(F.col(name), F.lit(float("nan"))))

    def instant(name: str, nulls: str) -> Column:
        return F.when(F.getbit(nulls, F.lit(len(_NUMBERS))) == 0, F.timestamp_micros(name))

    own = {"recorded_at": instant("us", "nulls")} | {c: number(c, i, "nulls") for i, c in enumerate(_NUMBERS)}
    prior = {"status": F.col("p_status"), "recorded_at": instant("p_us", "p_nulls"), "seq": F.col("p_seq")}
    prior |= {c: number(f"p_{c}", i, "p_nulls") for i, c in enumerate(_NUMBERS)}
    return out.select(
        *[own.get(c, F.col(c)).alias(c) for c in TELEMETRY.names], *[F.when(F.col("has_prior"), v).alias(f"{PRIOR}_{c}") for c, v in prior.items()],
        "fate", F.when(F.col("fate") == SILENCE, F.timestamp_micros("silent_us")).alias("silent_at"))

"""Request, counter, gauge, histogram and lag analysis: the service dashboards' queries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LATENCY_BOUNDS_MS, SkewPolicy, SloBounds
from ..functions import seconds_between
from .skew import SLICE, every_key, find_hot_keys, join_dimension, no_hot_keys, union_all, with_neighbour

HOUR = 3600.0
# Counts in a window become per-second rates by dividing by its length.


def window_start(ts: str, length: str) -> Column:
    return F.window(ts, length)["start"].alias("window_start")


def route_or_path(route: str = "route", path: str = "path") -> Column:
    """The route template; the raw path where no route matched."""
    return F.coalesce(F.col(route), F.col(path))


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests per method, route and status; those that matched no route count under their path, if there is one."""
    route = route_or_path() if "path" in requests.columns else F.col("route")
    return requests.groupBy("method", route.alias("route"), "status_code").agg(F.count(F.lit(1)).alias("n"))


def rate_per_window(rows: DataFrame, by: Sequence[str], ts: str = "ts", length: str = "1 hour",
                    seconds: float = HOUR) -> DataFrame:
    """Rows per second in each window and group."""
    counted = rows.groupBy(window_start(ts, length), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("rate_per_s", F.col("n") / F.lit(seconds))


def errors(requests: DataFrame) -> DataFrame:
    """Requests whose status is not 2xx, as two bounds that reach the scan."""
    return requests.filter((F.col("status_code") < 200) | (F.col("status_code") > 299))


def per_minute(rows: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    """Rows of each minute and group: (minute, by, n)."""
    return rows.groupBy(F.date_trunc("minute", ts).alias("minute"), *by).agg(F.count(F.lit(1)).alias("n"))


def sliding_over(counts: DataFrame, by: Sequence[str], minutes: int = 4) -> DataFrame:
    """Sums of per-minute counts, whole or in parts, over the windows that cover them."""
    starts = F.sequence(
        F.col("minute") - F.expr(f"interval {minutes - 1} minutes"), F.col("minute"), F.expr("interval 1 minute"))
    covered = counts.select(F.explode(starts).alias("window_start"), *by, "n")
    summed = covered.groupBy("window_start", *by).agg(F.sum("n").alias("n"))
    return summed.withColumn("rate_per_s", F.col("n") / F.lit(minutes * 60.0))


def sliding_rate(rows: DataFrame, by: Sequence[str], ts: str = "ts", minutes: int = 4) -> DataFrame:
    """Counts over ``minutes``-long windows that start every minute.

    Rows are counted per minute first; only those counts are copied to the windows that
    cover them, not the rows.
    """
    return sliding_over(per_minute(rows, by, ts), by, minutes)


# -- histograms -------------------------------------------------------------------------

def cumulative_buckets(rows: DataFrame, value: str, by: Sequence[str],
                       bounds: Sequence[float] = LATENCY_BOUNDS_MS) -> DataFrame:
    """Cumulative bucket counts (le, value) per group; ``le`` is null for +Inf.

    One hash aggregate with a counter per bound: cumulative by construction, no window.
    """
    counters = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        *counters, F.count(F.lit(1)).alias(f"_b{len(bounds)}"))
    edges = [F.lit(float(b)) for b in bounds] + [F.lit(None).cast("double")]
    buckets = F.array(*[F.struct(le.alias("le"), F.col(f"_b{i}").alias("value")) for i, le in enumerate(edges)])
    return counted.select(*by, F.inline(buckets))


def histogram_quantile(buckets: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """The q-quantile estimated from cumulative buckets, linear inside the bucket.

    Falls back to the highest finite bound in the +Inf bucket; null for an empty group.
    Windows span one group's buckets only.
    """
    ordered = Window.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    group = Window.partitionBy(*by)
    prepared = buckets.select(
        *by, "le", "value",
        F.lag("le").over(ordered).alias("_low"), F.lag("value", 1, 0).over(ordered).alias("_below"),
        (F.max("value").over(group) * F.lit(q)).alias("_rank"),
        F.count(F.lit(1)).over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("_nth"),
    )
    reached = prepared.filter(F.col("value") >= F.col("_rank"))
    first = reached.groupBy(*by).agg(F.min_by(
        F.struct("le", "value", "_low", "_below", "_rank"), "_nth").alias("b"))
    b = lambda name: F.col(f"b.{name}")
    low = F.coalesce(b("_low"), F.lit(0.0))
    inside = low + (b("le") - low) * ((b("_rank") - b("_below")) / (b("value") - b("_below")))
    estimate = (
        F.when(b("_rank") == 0, F.lit(None))
        .when(b("le").isNull(), b("_low"))
        .when(b("_low").isNull() & (b("le") <= 0), b("le")).otherwise(inside)
    )
    return first.select(*by, F.lit(q).alias("q"), estimate.cast("double").alias("quantile"))


def bucket_samples(rows: DataFrame, value: str, by: Sequence[str],
                   bounds: Sequence[float] = LATENCY_BOUNDS_MS) -> DataFrame:
    """Cumulative bucket counters (ts, by, le, value), sampled each minute and reset each day.

    Rows are counted per minute first, so at most 1440 samples per bucket and day are ordered.
    """
    per_minute = cumulative_buckets(rows.withColumn("ts", F.date_trunc("minute", "ts")), value, ["ts", *by], bounds)
    day = Window.partitionBy(*by, "le", F.to_date("ts")).orderBy("ts")
    total = F.sum("value").over(day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per_minute.select("ts", *by, "le", total.alias("value"))


def windowed_histogram_quantiles(samples: DataFrame, by: Sequence[str], probs: Sequence[float],
                                 length: str = "1 hour") -> DataFrame:
    """Quantiles per window and group from what the bucket counters (ts, by, le, value) gained in it.

    Buckets of series that ``by`` does not tell apart must be added up before. A counter's first sample is no gain.
    """
    steps = counter_increases(samples, [*by, "le"])
    gained = steps.groupBy(window_start("ts", length), *by, "le").agg(F.sum("increase").alias("value"))
    return union_all([histogram_quantile(gained, ["window_start", *by], p) for p in probs])


def exact_quantiles(rows: DataFrame, value: str, by: Sequence[str], probs: Sequence[float],
                    slices: int = 128) -> DataFrame:
    """Exact interpolated quantiles, without gathering a group's values in one task.

    Equal values are counted together. A sketch of each group's values cuts them into ``slices`` of about equal
    depth, whatever their unit; the exact totals of the slices tell which ones hold a wanted rank, and only those are
    put in order. A null in ``by`` makes a group like any other; NaN is the largest value.
    """
    keys = ["_group", *by]  # the group as text, which is never null, so that joins keep null groups
    rows = rows.withColumn("_group", F.to_json(F.struct(*by)) if by else F.lit(""))
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    edges = [i / slices for i in range(1, slices)]
    cuts = counts.groupBy("_group").agg(
        F.percentile_approx(F.when(~F.isnan("_v"), F.col("_v")), edges, 10 * slices).alias("_cuts"))
    tagged = join_dimension(counts, cuts, every_key("_group"), "_v", "inner").select(
        *keys, "_v", "_n", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.lit(-1)).alias(SLICE))
    totals = tagged.groupBy("_group", SLICE).agg(F.sum("_n").alias("_in"))  # a row per slice of a group
    group = Window.partitionBy("_group")
    totals = totals.select("_group", SLICE, "_in", F.sum("_in").over(group).alias("_size"),
                           (F.sum("_in").over(group.orderBy(SLICE)) - F.col("_in")).alias("_before"))
    places = [(F.col("_size") - 1) * F.lit(float(p)) for p in probs]
    held = [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_in")) for x in places for r in (F.floor(x), F.ceil(x))]
    wanted = totals.filter(reduce(Column.__or__, held)).drop("_in")
    run = Window.partitionBy("_group", SLICE).orderBy("_v")
    ranked = tagged.join(wanted, ["_group", SLICE]).withColumn("_upto", F.sum("_n").over(run) + F.col("_before"))

    def at_rank(rank: Column, name: str) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_v"))).alias(name)

    aggregates, results = [], []
    for i, (p, place) in enumerate(zip(probs, places, strict=True)):
        aggregates += [
            at_rank(F.floor(place), f"_lo{i}"), at_rank(F.ceil(place), f"_hi{i}"),
            F.max(place - F.floor(place)).alias(f"_part{i}"),
        ]
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        results.append(F.struct(F.lit(float(p)).alias("q"), (lo + (hi - lo) * F.col(f"_part{i}")).alias("quantile")))
    found = ranked.groupBy(*keys).agg(*aggregates)
    return found.select(*by, F.inline(F.array(*results)))


def approx_quantiles(rows: DataFrame, value: str, by: Sequence[str], probs: Sequence[float],
                     accuracy: int = 10_000) -> DataFrame:
    """Sketch-based quantiles: one aggregate, bounded memory, error about 1/accuracy in rank."""
    sketch = F.percentile_approx(value, [float(p) for p in probs], accuracy).alias("_q")
    found = rows.groupBy(*by).agg(sketch)
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("q"), F.col("_q").alias("quantile"))
    return found.select(*by, F.explode(pairs).alias("_p")).select(*by, F.col("_p")["q"].alias("q"),
                                                                  F.col("_p")["quantile"].alias("quantile"))


SKETCH_K = 800  # size of a quantile sketch; its rank error is then about half a per cent
SKETCH_BOUND = 0.01


def daily_sketches(rows: DataFrame, value: str, by: Sequence[str], ts: str = "ts", k: int = SKETCH_K) -> DataFrame:
    """(day, by, n, sketch): a mergeable quantile sketch of each day, to be stored and added up over any days."""
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return known.groupBy(F.to_date(ts).alias("day"), *by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(value, k).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, by: Sequence[str], probs: Sequence[float], k: int = SKETCH_K) -> DataFrame:
    """Quantiles of all days given, from their sketches alone."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    each = F.array(*[F.struct(F.lit(float(p)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("quantile")) for p in probs])
    return merged.select(*by, "n", F.inline(each))


def rank_errors(rows: DataFrame, value: str, by: Sequence[str], estimates: DataFrame) -> DataFrame:
    """``estimates`` (by, q, quantile, a few per group) with ``rank_error``: how far q lies from the exact ranks of the estimate."""
    few = F.broadcast(estimates.groupBy(*by).agg(F.collect_list(F.struct("q", "quantile")).alias("_e")))  # a row per group
    known = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).join(few, list(by))
    each = known.select(*by, F.col(value).alias("_v"), F.explode("_e").alias("_e"))
    counted = each.groupBy(*by, F.col("_e.q").alias("q"), F.col("_e.quantile").alias("quantile")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v") < F.col("_e.quantile")).alias("_below"), F.count_if(F.col("_v") <= F.col("_e.quantile")).alias("_upto"))
    off = F.greatest(F.col("_below") / F.col("n") - F.col("q"), F.col("q") - F.col("_upto") / F.col("n"), F.lit(0.0))
    return counted.select(*by, "q", "n", "quantile", off.alias("rank_error"))


# -- counters and gauges ----------------------------------------------------------------

def counter_samples(rows: DataFrame, label: str, name: str) -> DataFrame:
    """A cumulative counter per label value, sampled each minute and reset each day.

    Counting per minute first leaves at most 1440 rows per label value and day to order.
    """
    per_minute = rows.groupBy(F.date_trunc("minute", "ts").alias("ts"), F.col(label)).agg(
        F.count(F.lit(1)).alias("_n"))
    day = Window.partitionBy(label, F.to_date("ts")).orderBy("ts")
    total = F.sum("_n").over(day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return per_minute.select(
        "ts", F.lit(name).alias("name"), F.create_map(F.lit(label), F.col(label)).alias("labels"),
        F.lit(None).cast("double").alias("le"), total.cast("double").alias("value"))


def counter_increases(samples: DataFrame, series: Sequence[str], policy: SkewPolicy | None = None) -> DataFrame:
    """Increase and rate from each sample to the next of its series.

    A value below its predecessor means the counter restarted, so all of it is new. Unlike
    Prometheus, nothing is extrapolated to the edges of a range. Samples of a minute or more
    apart need no ``policy``: a series has 1440 a day. With one, large series are split.
    """
    hot = no_hot_keys(*series) if policy is None else find_hot_keys(samples, *series, position=F.unix_micros("ts"), policy=policy)
    rows = with_neighbour(
        samples, hot, ["ts"], ["value"], "prev", position=F.unix_micros("ts"),
        policy=SkewPolicy() if policy is None else SkewPolicy(hot_rows=policy.hot_rows * 1_000_000))
    was = F.col("prev_value")
    increase = F.when(F.col("value") < was, F.col("value")).otherwise(F.col("value") - was)
    elapsed = seconds_between(F.col("ts"), F.col("prev_ts"))
    return rows.filter(F.col("prev_ts").isNotNull()).select(
        *series, "ts", increase.alias("increase"), (increase / elapsed).alias("rate_per_s"))


def counter_rate(samples: DataFrame, series: Sequence[str], length: str = "1 hour", seconds: float = HOUR,
                 policy: SkewPolicy | None = None) -> DataFrame:
    """Per window and series: the counter's increase and its average per second."""
    steps = counter_increases(samples, series, policy)
    return steps.groupBy(window_start("ts", length), *series).agg(F.sum("increase").alias("increase")).withColumn(
        "rate_per_s", F.col("increase") / F.lit(seconds))


def latest_sample(samples: DataFrame, series: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    return samples.groupBy(*series).agg(F.max_by(value, F.struct(*order)).alias(value))


def gauge_max(samples: DataFrame, by: Sequence[str], series: Sequence[str], value: str = "value",
              order: Sequence[str] = ("ts",)) -> DataFrame:
    """The largest of the series' latest samples, per group."""
    last = latest_sample(samples, [*by, *series], value, order)
    return last.groupBy(*by).agg(F.max(value).alias(value))


def gauge_drop_rate(samples: DataFrame, series: Sequence[str], length: str = "1 hour") -> DataFrame:
    """How fast a gauge falls, by least squares in each window; zero while it rises."""
    start = F.col("window_start")
    placed = samples.withColumn("window_start", F.window("ts", length)["start"])
    offset = seconds_between(F.col("ts"), start)
    slope = placed.groupBy("window_start", *series).agg(
        F.regr_slope(F.col("value").cast("double"), offset).alias("_slope"))
    return slope.select("window_start", *series, F.when(
        F.col("_slope").isNotNull(), F.greatest(F.lit(0.0), -F.col("_slope"))).alias("drop_per_s"))


# -- replication lag --------------------------------------------------------------------

def lag_by_source(samples: DataFrame) -> DataFrame:
    """Reported byte lags; unreported ones are skipped, nameless sources are 'standby'."""
    name = F.coalesce(F.nullif(F.col("application_name"), F.lit("")), F.lit("standby"))
    return samples.filter(F.col("lag_bytes").isNotNull()).withColumns({
        "application_name": name, "lag_bytes": F.col("lag_bytes").cast("long")})


def freshness_max(samples: DataFrame) -> DataFrame:
    """One row: the largest number of seconds behind among samples (now, replay_ts)."""
    return samples.agg(F.max(freshness_seconds(F.col("now"), F.col("replay_ts"))).alias("lag_s"))


def freshness_seconds(now: Column, replayed: Column) -> Column:
    """Seconds behind, never negative; null while nothing was replayed."""
    return F.when(replayed.isNotNull(), F.greatest(F.lit(0.0), seconds_between(now, replayed)))


# -- objectives -------------------------------------------------------------------------

def slo_report(requests: DataFrame, bounds: SloBounds = SloBounds()) -> DataFrame:
    """One row: p95 latency and the error, check and failure rates against their bounds."""
    code = F.col("status_code")
    rates = requests.agg(
        F.avg((code != 201).cast("double")).alias("error_rate"),
        F.avg((code == 201).cast("double")).alias("check_rate"),
        F.avg((~code.between(200, 399)).cast("double")).alias("failed_rate"),
        F.count(F.lit(1)).alias("requests"),
    ).withColumn("_one", F.lit(1))
    p95 = exact_quantiles(requests, "duration_ms", [], [0.95]).select(
        F.col("quantile").alias("p95_ms"), F.lit(1).alias("_one"))
    passed = (
        (F.col("p95_ms") < bounds.p95_ms) & (F.col("error_rate") < bounds.max_error_rate)
        & (F.col("check_rate") > bounds.min_check_rate) & (F.col("failed_rate") < bounds.max_failed_rate)
    )
    # one row each
    return rates.join(p95, "_one").drop("_one").withColumn("passed", passed)


def stage_throughput(stages: DataFrame, names: Sequence[str], length: str = "1 hour",
                     seconds: float = HOUR) -> DataFrame:
    """Events (ts, stage) per second, the stages side by side."""
    counts = [F.count_if(F.col("stage") == n).alias(n) for n in names]
    counted = stages.groupBy(window_start("ts", length)).agg(*counts)
    return counted.select("window_start", *[(F.col(n) / F.lit(seconds)).alias(n) for n in names])

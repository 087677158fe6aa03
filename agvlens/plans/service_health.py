"""Queries: requests, rates, histograms, gauges, lag, traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, traces
from ..session import stored
from .live_view import whole_feed
from .oracle_views import windowed_quantiles_sql
from .registry import query

HOUR_SQL = "date_trunc('hour', ts)"
PROBS = [0.5, 0.95]


def rounded(df, *columns: str):
    """Six decimals: sums of doubles differ in the last bits between engines."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("request_counts", """
select 'POST' as method, coalesce(route, path) as route, status_code, count(*) as n from unrouted group by 2, 3""")
def request_counts(t):
    return metrics.request_counts(t.requests_unrouted())


@query("request_rate_by_route", f"""
select {HOUR_SQL} as window_start, route, count(*) as n, count(*)/3600.0::double as rate_per_s from requests group by 1, 2""")
def request_rate_by_route(t):
    return metrics.rate_per_window(t.requests(), ["route"])


@query("error_rate", f"""
select {HOUR_SQL} as window_start, status_code, route, count(*) as n, count(*)/3600.0::double as rate_per_s
from requests where status_code not between 200 and 299 group by 1, 2, 3""")
def error_rate(t):
    return metrics.rate_per_window(metrics.errors(t.requests()), ["status_code", "route"])


@query("error_rate_total", f"""
select {HOUR_SQL} as window_start, count(*) as n, count(*)/3600.0::double as rate_per_s
from requests where status_code not between 200 and 299 group by 1""")
def error_rate_total(t):
    return metrics.rate_per_window(metrics.errors(t.requests()), [])


@query("latency_histogram", "select route, le, value from buckets")
def latency_histogram(t):
    return metrics.cumulative_buckets(t.requests(), "duration_ms", ["route"])


@query("latency_quantiles", """
select route, q, round(case when q=0.5 then quantile_cont(duration_ms, 0.5) else quantile_cont(duration_ms, 0.95) end, 6) as quantile
from unrouted, (values (0.5::double), (0.95::double)) as p(q) group by route, q""")
def latency_quantiles(t):
    """Requests without a route are a group of their own."""
    return rounded(metrics.exact_quantiles(t.requests_unrouted(), "duration_ms", ["route"], PROBS), "quantile")


@query("latency_quantiles_sketch", """
select route, q, count(*) as n, true as within_bound from requests, (values (0.5::double), (0.95::double)) as p(q) group by 1, 2""")
def latency_quantiles_sketch(t):
    """Quantiles from stored sketches of each day, merged; each is held against the exact ranks of its value."""
    sketches = stored(metrics.daily_sketches(t.requests(), "duration_ms", ["route"]), "latency-sketches")
    found = metrics.sketched_quantiles(sketches, ["route"], PROBS)
    held = metrics.rank_errors(t.requests(), "duration_ms", ["route"], found.drop("n"))
    return held.select("route", "q", "n", (F.col("rank_error") <= metrics.SKETCH_BOUND).alias("within_bound"))


@query("latency_quantiles_approx")
def latency_quantiles_approx(t):
    """One pass, nothing stored; sketches differ between engines, so there is no SQL to equal."""
    return metrics.approx_quantiles(t.requests(), "duration_ms", ["route"], PROBS)


@query("histogram_quantile", """
select route, 0.95::double as q, round(case when le is null then low
    else coalesce(low, 0) + (le-coalesce(low, 0))*((rank-below)/(value-below)) end, 6) as quantile
from (select *, row_number() over (partition by route order by le nulls last) as n from (
        select route, le, value, 0.95::double*max(value) over (partition by route) as rank,
          lag(le) over (partition by route order by le nulls last) as low,
          coalesce(lag(value) over (partition by route order by le nulls last), 0) as below from buckets)
      where value>=rank)
where n=1""")
def histogram_quantile(t):
    buckets = metrics.cumulative_buckets(t.requests(), "duration_ms", ["route"])
    return rounded(metrics.histogram_quantile(buckets, ["route"], 0.95), "quantile")


@query("histogram_quantile_windowed", windowed_quantiles_sql("requests", "route", "duration_ms"))
def histogram_quantile_windowed(t):
    samples = metrics.bucket_samples(t.requests(), "duration_ms", ["route"])
    return rounded(metrics.windowed_histogram_quantiles(samples, ["route"], PROBS), "quantile")


@query("decode_lag_quantiles_by_type", windowed_quantiles_sql("decoding", "type", "lag_ms"))
def decode_lag_quantiles_by_type(t):
    samples = metrics.bucket_samples(t.decode_samples(), "lag_ms", ["type"])
    return rounded(metrics.windowed_histogram_quantiles(samples, ["type"], PROBS), "quantile")


@query("decode_lag_quantiles", windowed_quantiles_sql("(select ts, 'all' as type, lag_ms from decoding)", "type", "lag_ms"))
def decode_lag_quantiles(t):
    samples = metrics.bucket_samples(t.decode_samples().withColumn("type", F.lit("all")), "lag_ms", ["type"])
    return rounded(metrics.windowed_histogram_quantiles(samples, ["type"], PROBS), "quantile")


@query("feed_throughput_by_type", f"""
select {HOUR_SQL} as window_start, type, count(*) as n, count(*)/3600.0::double as rate_per_s from feed group by 1, 2""")
def feed_throughput_by_type(t):
    return metrics.rate_per_window(whole_feed(t), ["type"])


@query("feed_rate_sliding", """
select window_start, type, cast(sum(n) as bigint) as n, sum(n)/240.0::double as rate_per_s from (
  select unnest(generate_series(minute - interval 3 minute, minute, interval 1 minute)) as window_start, type, n
  from (select date_trunc('minute', ts) as minute, type, count(*) as n from feed group by 1, 2))
group by 1, 2""")
def feed_rate_sliding(t):
    return metrics.sliding_rate(whole_feed(t), ["type"])


@query("stage_throughput", """
select window_start, count(*) filter (stage='ingress')/3600.0::double as ingress,
  count(*) filter (stage='publish')/3600.0::double as publish, count(*) filter (stage='deliver')/3600.0::double as deliver
from (select date_trunc('hour', ts) as window_start, 'ingress' as stage from requests
      union all select date_trunc('hour', ts), 'publish' from feed
      union all select date_trunc('hour', start_ts), 'deliver' from spans where kind='CONSUMER')
group by 1""")
def stage_throughput(t):
    stage = lambda df, name, ts="ts": df.select(F.col(ts).alias("ts"), F.lit(name).alias("stage"))
    stages = stage(t.requests(), "ingress").unionByName(
        stage(whole_feed(t), "publish")).unionByName(
        stage(t.spans().filter(F.col("kind") == "CONSUMER"), "deliver", "start_ts"))
    return metrics.stage_throughput(stages, ["ingress", "publish", "deliver"])


@query("counter_rate", f"""
select {HOUR_SQL} as window_start, route, sum(inc) as increase, sum(inc)/3600.0::double as rate_per_s from (
  select ts, route, case when value<was then value else value-was end as inc from (
    select *, lag(value) over (partition by route order by ts) as was from metric_samples) where was is not null)
group by 1, 2""")
def counter_rate(t):
    samples = t.metric_samples().withColumn("route", F.col("labels")["route"])
    return metrics.counter_rate(samples, ["route"])


@query("gauge_max", f"""
select window_start, max(value) as value from (
  select {HOUR_SQL} as window_start, route, max_by(value, ts) as value from connections group by 1, 2) group by 1""")
def gauge_max(t):
    samples = t.connections().withColumn("window_start", F.date_trunc("hour", "ts"))
    return metrics.gauge_max(samples, ["window_start"], ["route"])


@query("gauge_drop_rate", f"""
select window_start, route, round(case when slope is not null then greatest(0.0, -slope) end, 6) as drop_per_s from (
  select {HOUR_SQL} as window_start, route,
    regr_slope(value, (epoch_us(ts)-epoch_us({HOUR_SQL}))/1000000.0::double) as slope from connections group by 1, 2)""")
def gauge_drop_rate(t):
    return rounded(metrics.gauge_drop_rate(t.connections(), ["route"]), "drop_per_s")


@query("lag_by_source", "select ts, application_name, lag_bytes from lag_reported")
def lag_by_source(t):
    return metrics.lag_by_source(t.lag_samples())


@query("lag_max_by_source", """
select application_name, max_by(lag_bytes, (ts, lag_bytes)) as lag_bytes from lag_reported group by 1""")
def lag_max_by_source(t):
    samples = metrics.lag_by_source(t.lag_samples())
    return metrics.gauge_max(samples, ["application_name"], [], "lag_bytes", ("ts", "lag_bytes"))


@query("lag_max_total", """
select max(lag_bytes) as lag_bytes from (
  select application_name, max_by(lag_bytes, (ts, lag_bytes)) as lag_bytes from lag_reported group by 1)""")
def lag_max_total(t):
    samples = metrics.lag_by_source(t.lag_samples())
    return metrics.gauge_max(samples, [], ["application_name"], "lag_bytes", ("ts", "lag_bytes"))


@query("freshness_lag_max", "select max(case when k%7<>0 then greatest(0.0, (k-5)*0.25)::double end) as lag_s from ev")
def freshness_lag_max(t):
    return metrics.freshness_max(t.replay_samples())


@query("freshness_lag", """
select event_id as seq, case when k%7<>0 then greatest(0.0, (k-5)*0.25)::double end as lag_s from ev""")
def freshness_lag(t):
    lag = metrics.freshness_seconds(F.col("now"), F.col("replay_ts"))
    return t.replay_samples().select("seq", lag.alias("lag_s"))


@query("slo_report", """
select count(*) as requests, avg((status_code<>201)::int) as error_rate, avg((status_code=201)::int) as check_rate,
  avg((status_code not between 200 and 399)::int) as failed_rate, round(quantile_cont(duration_ms, 0.95), 6) as p95_ms,
  quantile_cont(duration_ms, 0.95)<750 and avg((status_code<>201)::int)<0.05 and avg((status_code=201)::int)>0.95
    and avg((status_code not between 200 and 399)::int)<0.05 as passed
from requests""")
def slo_report(t):
    return rounded(metrics.slo_report(t.requests()), "p95_ms")


@query("span_search", """
select trace_id, span_id, name, start_ts, duration_ms from spans
where service='frontend-api' and name='HTTP GET' and method='GET'""")
def span_search(t):
    found = traces.span_search(t.spans(), "frontend-api", "HTTP GET", {"http.method": "GET"})
    return found.select("trace_id", "span_id", "name", "start_ts", "duration_ms")


@query("recent_traces", """
select trace_id, max(start_ts) as last_start, count(*) as spans from spans where service='cdc-consumer'
group by 1 order by last_start desc, trace_id desc limit 20""")
def recent_traces(t):
    return traces.recent_traces(t.spans(), "cdc-consumer")


@query("trace_conjunction", """
select trace_id from spans where service='browser' intersect select trace_id from spans where service='frontend-api'""")
def trace_conjunction(t):
    return traces.traces_with_all(t.spans(), "browser", "frontend-api")


@query("service_graph_edges", """
select client, server, instrumented, count(*) as calls, round(avg(ms), 6) as avg_ms from (
  select c.service as client, coalesce(s.service, c.peer) as server, s.service is not null as instrumented,
    coalesce(s.duration_ms, c.duration_ms) as ms
  from spans c left join spans s on s.trace_id=c.trace_id and s.parent_span_id=c.span_id
    and ((c.kind='CLIENT' and s.kind='SERVER') or (c.kind='PRODUCER' and s.kind='CONSUMER'))
  where c.kind in ('CLIENT','PRODUCER'))
where server is not null group by 1, 2, 3""")
def service_graph_edges(t):
    return rounded(traces.service_graph(t.spans()), "avg_ms")

"""Queries over trace spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Span kinds that meet across a service boundary.
CALLER_TO_CALLEE = {"CLIENT": "SERVER", "PRODUCER": "CONSUMER"}


def span_search(spans: DataFrame, service: str, name: str | None = None,
                attributes: dict[str, str] | None = None) -> DataFrame:
    """Spans of a service, optionally of one name and with given attribute values."""
    wanted = F.col("service") == service
    if name is not None:
        wanted &= F.col("name") == name
    for key, value in (attributes or {}).items():
        wanted &= F.col("attributes")[key] == value
    return spans.filter(wanted)


def recent_traces(spans: DataFrame, service: str, limit: int = 20) -> DataFrame:
    """The traces a service took part in most recently."""
    per_trace = span_search(spans, service).groupBy("trace_id").agg(
        F.max("start_ts").alias("last_start"), F.count(F.lit(1)).alias("spans"))
    return per_trace.orderBy(F.desc("last_start"), F.desc("trace_id")).limit(limit)


def traces_with_all(spans: DataFrame, *services: str) -> DataFrame:
    """Traces with at least one span of each service: one map-side combined aggregate."""
    seen = [F.bool_or(F.col("service") == s).alias(f"_s{i}") for i, s in enumerate(services)]
    per_trace = spans.filter(F.col("service").isin(*services)).groupBy("trace_id").agg(*seen)
    for i in range(len(services)):
        per_trace = per_trace.filter(F.col(f"_s{i}"))
    return per_trace.select("trace_id")


def service_graph(spans: DataFrame, peer_attribute: str = "server.address") -> DataFrame:
    """Edges between services: number of calls and mean latency of the called side.

    A caller whose callee left no span still gives an edge if it names its peer. Callees are
    added up per caller span before the join, so a span with very many children arrives there
    as one row per called service, and both sides are unique on the join key's span.
    """
    pairs = [F.when(F.col("kind") == caller, callee) for caller, callee in CALLER_TO_CALLEE.items()]
    callers = spans.filter(F.col("kind").isin(*CALLER_TO_CALLEE)).select(
        "trace_id", "span_id", F.col("service").alias("client"), F.coalesce(*pairs).alias("kind"),
        F.col("duration_ms").alias("_waited"), F.col("attributes")[peer_attribute].alias("_peer"))
    called = spans.filter(F.col("kind").isin(*CALLER_TO_CALLEE.values()) & F.col("parent_span_id").isNotNull())
    callees = called.groupBy("trace_id", F.col("parent_span_id").alias("span_id"), "kind", "service").agg(
        F.count(F.lit(1)).alias("_calls"), F.sum("duration_ms").alias("_took"))
    met = callers.join(callees, ["trace_id", "span_id", "kind"], "left")
    edges = met.select(
        "client", F.coalesce("service", "_peer").alias("server"), F.col("service").isNotNull().alias("instrumented"),
        F.coalesce("_calls", F.lit(1)).alias("_calls"), F.coalesce("_took", "_waited").alias("_ms"))
    return edges.filter(F.col("server").isNotNull()).groupBy("client", "server", "instrumented").agg(
        F.sum("_calls").alias("calls"), (F.sum("_ms") / F.sum("_calls")).alias("avg_ms"))

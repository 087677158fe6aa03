"""Quality rules: a few fixed bounds, then robust multivariate outliers.

Each text gives counts (`text_statistics`); the counts give a vector of transformed shares (`vector`). Per language
and source a minimum-covariance-determinant estimate of location and scatter is fitted over all rows that pass the
fixed bounds, and a text whose squared Mahalanobis distance exceeds the cutoff is rejected.

The estimate needs no group in one place: every concentration step is a pair of aggregations that combine before the
shuffle, one counting distances on a fixed grid (which gives the exact grid cell of the h-quantile), one adding up
moments of the rows inside it. Two starts (grid medians and spreads; plain moments) are run side by side and the one
of smaller determinant wins. Groups under ``min_group`` rows are pooled by language; those still too small are held against an
estimate over all good rows of the corpus, so rare languages keep no outliers either. Only a corpus that itself has fewer than
``inner_share * min_group / 2`` good rows has no estimate, and rejects nothing by distance.

Defined cases: a null text is an empty one; null languages and sources are groups of their own; a text that fails the
fixed bounds takes no part in the estimates; an empty table gives an empty table; repeated rows count each; a very long text is
counted whole, in memory that grows with its length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import group_key, whole_row, written

SYMBOLS = "#*$%&|<>"
WINDOW = 8  # words in a repeated window
GRID = 64  # grid cells per unit of a vector's component, and per doubling of a distance

# The counts made of a text.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper")
_STATS = ", ".join(f"{c} long" for c in COUNTS)


@dataclass(frozen=True)
class QualityBounds:
    min_words: int = 20
    max_repeat_pct: int = 30
    inner_share: float = 0.75  # h: the share of a group that the estimate rests on
    steps: int = 3  # concentration steps
    cutoff: float = 40.0  # squared distance; the 0.999 quantile of six normal variables is 22.5
    min_group: int = 200


# Components, and the least spread each is given (a share that is zero nearly everywhere has none).
COMPONENTS = ("word_length", "symbols", "dup_lines", "repeats", "marks", "upper")
FLOOR = np.array([0.05, 0.10, 0.12, 0.10, 0.10, 0.08])
P = len(COMPONENTS)


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` (a power of two) words that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    step = 1
    while step < width:  # windows of 2, 4, 8 words get numbers from the numbers of their halves
        pair = ids[:-step] * (len(words) + 1) + ids[step:]
        _, ids = np.unique(pair, return_inverse=True)
        if ids.max(initial=-1) + 1 == len(ids):
            return 0
        step *= 2
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8")
    words = data.split()  # ASCII white space, as in the word pattern
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    blanks = sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(data.count(s) for s in _SYMBOL_BYTES)
    marks = sum(data.count(s) for s in _MARK_BYTES)
    upper = len(data) - len(data.translate(None, _UPPER))
    return (len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines), marks, upper)


_SYMBOL_BYTES = [c.encode() for c in SYMBOLS]
_MARK_BYTES = [c.encode() for c in ".,!?;:"]
_UPPER = bytes(range(65, 91))


def _statistics_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([counts_of(t) for t in batch], columns=list(COUNTS), dtype="int64")


def text_statistics(text: str) -> Column:
    """COUNTS of a text column, as a struct.

    Marked as if two runs could differ: a filter on the counts would otherwise be moved below them with a copy of this call, which reads
    every text twice and keeps two Python workers for a task.
    """
    return F.pandas_udf(_statistics_of, _STATS).asNondeterministic()(F.col(text))


def base_failed(s: str, b: QualityBounds) -> Column:
    return (F.col(f"{s}.n_words") < b.min_words) | (100 * F.col(f"{s}.n_repeat_words") > b.max_repeat_pct * F.col(f"{s}.n_words"))


def vector(s: str) -> list[Column]:
    """Shares, steadied for short texts by adding typical words, on scales where typical texts scatter evenly."""
    n = F.col(f"{s}.n_words")
    share = lambda c, extra: F.sqrt(F.col(f"{s}.{c}") / (n + extra))
    return [
        4 * F.log((F.col(f"{s}.word_chars") + 150.0) / (n + 30.0)),
        share("n_symbols", 30.0),
        F.sqrt(F.col(f"{s}.n_dup_lines") / (F.col(f"{s}.n_lines") + 10.0)),
        share("n_repeat_words", 30.0),
        F.log((F.col(f"{s}.n_marks") + 5.0) / (n + 30.0)),
        share("n_upper", 30.0),
    ]


def _grid_quantiles(cells: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """From counts ``n`` per (keys, cell): the cells that hold the given shares, as columns q0, q1, ..."""
    w = Window.partitionBy(*keys)
    run = cells.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
    return run.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= F.ceil(s * F.col("all")), F.col("cell"))).alias(f"q{i}") for i, s in enumerate(shares)])


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    x = [F.col(f"x{i}") for i in range(P)]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(P)],
        *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(P) for j in range(i, P)],
    )


_ESTIMATE = "pool string, start int, n long, center array<double>, precision array<double>, logdet double"


def _estimate(center: np.ndarray, scatter: np.ndarray) -> tuple[list, list, float]:
    scatter = scatter + np.diag(FLOOR**2)
    precision = np.linalg.inv(scatter)
    return center.tolist(), ((precision + precision.T) / 2).ravel().tolist(), float(np.linalg.slogdet(scatter)[1])


def consistency(share: float, p: int = P) -> float:
    """Factor that makes the scatter of the inner ``share`` of normal rows that of all (even ``p``)."""
    def below(x: float, q: int) -> float:
        term = total = 1.0
        for k in range(1, q // 2):
            term *= x / 2 / k
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 200.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid, p) < share else (low, mid)
    return share / below(low, p + 2)


def _from_moments(factor: float):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                mean = np.array([r[f"s{i}"] for i in range(P)]) / r["n"]
                second = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(P)] for i in range(P)]) / r["n"]
                out.append((r["pool"], r["start"], r["n"], *_estimate(mean, factor * (second - np.outer(mean, mean)))))
            yield pd.DataFrame(out, columns=["pool", "start", "n", "center", "precision", "logdet"])

    return work


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the estimate joined to the row."""
    gap = [F.col(f"x{i}") - F.col("center")[i] for i in range(P)]
    parts = [F.col("precision")[i * P + j] * gap[i] * gap[j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.greatest(total, F.lit(0.0))


EVERY = "all"  # the pool of all good rows


def pools(keys: DataFrame, min_group: int) -> DataFrame:
    """The pool of each (lang, source): itself, its language's small groups, or ``EVERY`` row."""
    counts = keys.groupBy("lang", "source").agg(F.sum(F.col("good").cast("long")).alias("n"))
    own = counts.withColumn("pool", F.when(F.col("n") >= min_group, F.concat(F.lit("s:"), group_key("lang", "source"))))
    small = own.filter(F.col("pool").isNull())
    by_lang = small.groupBy(group_key("lang").alias("l")).agg(F.sum("n").alias("m"))
    placed = own.withColumn("l", group_key("lang")).join(by_lang, "l", "left")
    pool = F.coalesce("pool", F.when(F.col("m") >= min_group, F.concat(F.lit("l:"), F.col("l"))), F.lit(EVERY))
    return placed.select(group_key("lang", "source").alias("key"), pool.alias("pool"))


def fit(stats: DataFrame, bounds: QualityBounds = QualityBounds()) -> DataFrame:
    """Estimates (key, center, precision) for every (lang, source) of ``stats`` (lang, source, stats)."""
    good = ~base_failed("stats", bounds)
    placed = written(pools(stats.select("lang", "source", good.alias("good")), bounds.min_group), "quality-pools")
    rows = stats.filter(good).select(group_key("lang", "source").alias("key"), *[x.alias(f"x{i}") for i, x in enumerate(vector("stats"))])
    # groups without a pool of their own size are measured against all rows; if there are none such, that pool stays empty
    left_over = placed.filter(F.col("pool") == EVERY).select("pool").distinct()  # a row or none
    every = rows.drop("key").withColumn("pool", F.lit(EVERY)).join(F.broadcast(left_over), "pool", "left_semi")
    own = rows.join(placed.filter(F.col("pool") != EVERY), "key").drop("key")
    rows = written(own.unionByName(every), "quality-vectors")

    cells = rows.select("pool", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") * GRID) for i in range(P)])).alias("part", "cell"))
    spread = _grid_quantiles(cells.groupBy("pool", "part", "cell").agg(F.count(F.lit(1)).alias("n")), ["pool", "part"], [0.25, 0.5, 0.75])
    first = spread.groupBy("pool").agg(F.sort_array(F.collect_list(F.struct("part", "q0", "q1", "q2"))).alias("q"))  # P entries

    def robust_start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pool, q in zip(b["pool"], b["q"], strict=True):
                low, mid, high = (np.array([r[k] for r in q], float) / GRID for k in ("q0", "q1", "q2"))
                out.append((pool, 0, 0, *_estimate(mid + 0.5 / GRID, np.diag(((high - low) / 1.349) ** 2))))
            yield pd.DataFrame(out, columns=["pool", "start", "n", "center", "precision", "logdet"])

    plain = _moments(rows, ["pool"]).withColumn("start", F.lit(1)).mapInPandas(_from_moments(1.0), _ESTIMATE)
    now = written(first.mapInPandas(robust_start, _ESTIMATE).unionByName(plain), "quality-estimate")
    factor = consistency(bounds.inner_share)
    for _ in range(bounds.steps):
        near = rows.join(now, "pool").withColumn("cell", F.floor(F.log2(distance() + 1e-6) * GRID))
        counted = near.groupBy("pool", "start", "cell").agg(F.count(F.lit(1)).alias("n"))
        cut = written(_grid_quantiles(counted, ["pool", "start"], [bounds.inner_share]), "quality-cut")
        reach = now.join(cut, ["pool", "start"])
        inner = rows.join(reach, "pool").filter(F.floor(F.log2(distance() + 1e-6) * GRID) <= F.col("q0"))
        now = written(_moments(inner, ["pool", "start"]).mapInPandas(_from_moments(factor), _ESTIMATE), "quality-estimate")
    best = now.groupBy("pool").agg(F.min_by(F.struct("center", "precision"), F.struct("logdet", "start")).alias("e"), F.max("n").alias("n"))
    enough = best.filter(F.col("n") >= bounds.inner_share * bounds.min_group * 0.5)
    return written(placed.join(enough, "pool").select("key", "e.center", "e.precision"), "quality-model")


def verdicts(rows: DataFrame, model: DataFrame, bounds: QualityBounds = QualityBounds()) -> DataFrame:
    """``rows`` (with lang, source and a ``stats`` struct) plus base_failed, distance2 and kept."""
    x = rows.withColumn("__key", group_key("lang", "source")).withColumns({f"x{i}": v for i, v in enumerate(vector("stats"))})
    joined = x.join(model.withColumnRenamed("key", "__key"), "__key", "left")
    bad, d2 = base_failed("stats", bounds), distance()
    return joined.withColumns({
        "base_failed": bad, "distance2": d2, "kept": ~bad & ~F.coalesce(d2 > bounds.cutoff, F.lit(False)),
    }).drop("__key", "center", "precision", *[f"x{i}" for i in range(P)])


def judge(docs: DataFrame, bounds: QualityBounds = QualityBounds()) -> DataFrame:
    """doc_id, the counts, base_failed, distance2 and kept for every document."""
    stats = written(docs.select("doc_id", "lang", "source", text_statistics("text").alias("stats")), "quality-stats")
    return verdicts(stats, fit(stats, bounds), bounds).select("doc_id", "stats.*", "base_failed", "distance2", "kept")


def keep_good(docs: DataFrame, bounds: QualityBounds = QualityBounds()) -> DataFrame:
    """The documents that are kept, with the columns they came with. Texts are not shuffled."""
    slim = docs.select("lang", "source", text_statistics("text").alias("stats"))
    model = fit(written(slim, "quality-stats"), bounds)
    own = docs.select(whole_row(docs), "lang", "source", text_statistics("text").alias("stats"))
    return verdicts(own, model, bounds).filter("kept").select("doc.*")

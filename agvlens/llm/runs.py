"""Periodic runs of words through recompression.

The words of many documents stand in one sequence, between marks that occur once. Levels are made by turns: block compression
replaces each maximal repetition of a symbol by one symbol, pair compression each neighbouring pair of a left and a right symbol, the
alphabet being dealt anew on each level. Both cut where two neighbours say so and nowhere else, so equal stretches are cut alike but for
their rims. An extension query therefore reads at most one phrase a level on its way up to the level where the two sides differ,
and one on its way down to the exact place of the difference. The levels are a grammar of runs and pairs; they are made as far as queries climb.

A run of period p and length max(12, 2p) or more holds, among its pairs of words p apart, one that starts on the grid of max(p, 12 - p).
So every grid place whose word recurs p words on is extended to both sides by the grammar; what is long enough is a run, and of several periods
of one stretch the smallest is its own. Nothing is indexed but the levels, and all steps are numpy operations over the documents of a pack.

Defined cases: a null text has no words; a null doc_id damages nothing; ties and repeated rows get equal results; an empty table gives an
empty table; other columns are left out. A pack holds ``PACK`` words or one longer document, whose memory grows with its length;
grid places are made ``GRID`` at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEAST = 12  # words of a run
PACK = 150_000
GRID = 1 << 20
_ODD = 0x9E3779B97F4A7C15


class Level:
    """One level's symbols and how they are cut into the phrases that are the next level's symbols."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, blocks: bool):
        self.symbols, self.starts, self.blocks = symbols, starts, blocks
        self.up = np.cumsum(starts, dtype=np.int32) - np.int32(1)
        self.first = np.append(np.flatnonzero(starts), len(symbols)).astype(np.int32)  # and the end

    def mirrored(self) -> Level:
        other = object.__new__(Level)
        other.symbols, other.blocks = self.symbols[::-1], self.blocks
        other.starts = np.append(self.starts[1:], True)[::-1]
        other.up = (len(self.first) - 2 - self.up)[::-1]
        other.first = (len(self.symbols) - self.first)[::-1]
        return other


class Grammar:
    """Recompression of a sequence in which each negative number occurs once; the first and last symbols are negative."""

    def __init__(self, symbols: np.ndarray):
        self.top = symbols.astype(np.int64)
        self.size = int(symbols.max(initial=0)) + 1  # symbols given out
        self.rounds = 0
        self.levels: list[Level] = []
        self.mirrors: list[Level] = []

    def _named(self, starts: np.ndarray, blocks: bool, keys: np.ndarray, at: np.ndarray) -> None:
        """A level whose phrases at the places ``at`` get new symbols, equal ones for equal keys."""
        level = Level(self.top, starts, blocks)
        self.levels.append(level)
        self.mirrors.append(level.mirrored())
        above = self.top[level.first[:-1]]
        distinct, name = np.unique(keys, return_inverse=True)
        above[level.up[at]] = self.size + name
        self.size += len(distinct)
        self.top = above

    def grow(self) -> None:
        s = self.top
        same = s[1:] == s[:-1]
        if same.any():
            starts = np.append(True, ~same)
            first = np.flatnonzero(starts)
            length = np.diff(np.append(first, len(s)))
            many = length > 1
            self._named(starts, True, s[first[many]] * (len(s) + 1) + length[many], first[many])
            return
        while True:
            self.rounds += 1
            side = ((s.astype(np.uint64) * np.uint64(_ODD * (2 * self.rounds + 1) % (1 << 64))) >> np.uint64(40)) & np.uint64(1)
            left, right = (s >= 0) & (side == 0), (s >= 0) & (side == 1)
            pairs, turned = left[:-1] & right[1:], right[:-1] & left[1:]
            if turned.sum() > pairs.sum():
                pairs = turned
            if pairs.any():
                break
            if not ((s[1:] >= 0) & (s[:-1] >= 0)).any():
                raise ValueError("nothing left to compress")
        at = np.flatnonzero(pairs)
        self._named(np.append(True, ~pairs), False, s[at] * self.size + s[at + 1], at)

    def extend(self, i: np.ndarray, j: np.ndarray, backward: bool = False) -> np.ndarray:
        """How many symbols agree from places i and j on (i <> j), or from them back. The first ones must agree."""
        views = self.mirrors if backward else self.levels
        if backward:
            n = len(self.levels[0].symbols if self.levels else self.top)
            i, j = n - 1 - i, n - 1 - j
        at, x, y = np.arange(len(i)), i, j
        stopped: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[]]
        k = 0
        while len(at):
            if k == len(views):
                self.grow()
            level = views[k]
            s = level.symbols
            inside = ~(level.starts[x] & level.starts[y])
            if inside.any():
                if level.blocks:
                    # what is left of both blocks; the shorter one ends where the other goes on
                    rx, ry = level.first[level.up[x] + 1] - x, level.first[level.up[y] + 1] - y
                    move = np.where(inside, np.minimum(rx, ry), 0)
                else:
                    move = inside.astype(np.int32)
                x, y = x + move, y + move
                on = s[x] == s[y]
                stopped[k].append((at[~on], x[~on], y[~on]))
                at, x, y = at[on], x[on], y[on]
            x, y = level.up[x], level.up[y]
            k += 1
            stopped.append([])
            s = views[k].symbols if k < len(views) else self.top[::-1] if backward else self.top
            on = s[x] == s[y]
            stopped[k].append((at[~on], x[~on], y[~on]))
            at, x, y = at[on], x[on], y[on]
        at, x, y = (np.zeros(0, np.int64) for _ in range(3))
        for k in range(len(stopped) - 1, -1, -1):
            parts = [(at, x, y), *stopped[k]]
            at, x, y = (np.concatenate([p[c] for p in parts]) for c in range(3))
            if k:
                level = views[k - 1]
                fx, fy = level.first[x], level.first[y]
                same = level.symbols[fx] == level.symbols[fy]
                move = np.minimum(level.first[x + 1] - fx, level.first[y + 1] - fy) if level.blocks else 1
                move = np.where(same, move, 0)
                x, y = fx + move, fy + move
        agreed = np.empty(len(i), np.int64)
        agreed[at] = x - i[at]
        return agreed


def grid(lengths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods of the harmonic grids of all documents, ``GRID`` or one period's at a time."""
    half = lengths // 2 * (lengths >= LEAST)
    doc = np.repeat(np.arange(len(lengths)), half)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(half) - half, half) + 1
    pitch = np.maximum(period, LEAST - period)
    count = -(-(lengths[doc] - period) // pitch)
    ends = np.cumsum(count)
    a = 0
    while a < len(doc):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + GRID, "right")))
        row = np.repeat(np.arange(a, b, dtype=np.int32), count[a:b])
        nth = np.arange(len(row), dtype=np.int32) - np.repeat((ends[a:b] - count[a:b] - done).astype(np.int32), count[a:b])
        yield (starts[doc[a:b]].astype(np.int32))[row - a] + nth * pitch.astype(np.int32)[row], period.astype(np.int32)[row]
        a = b


def find_runs(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first place, end, period) of all runs of documents given as words, in order, and the place of each document's first word."""
    known: dict[bytes, int] = {}
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths
    symbols = np.empty(int(lengths.sum()) + len(texts) + 1, np.int64)
    symbols[0] = -1
    for d, (t, a) in enumerate(zip(texts, starts.tolist(), strict=True)):
        symbols[a:a + len(t)] = [known.setdefault(w, len(known)) for w in t]
        symbols[a + len(t)] = -2 - d
    grammar = Grammar(symbols)
    found = []
    for i, p in grid(lengths, starts):
        hit = symbols[i] == symbols[i + p]
        i, p = i[hit], p[hit]
        ahead = grammar.extend(i, i + p)
        back = np.zeros(len(i), np.int64)
        more = np.flatnonzero(symbols[i - 1] == symbols[i + p - 1])
        back[more] = grammar.extend(i[more] - 1, i[more] + p[more] - 1, True)
        long = back + ahead >= np.maximum(LEAST - p, p)
        i, p, ahead, back = i[long], p[long], ahead[long], back[long]
        found.append(np.stack([i - back, i + p + ahead, p]))
    runs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)  # of one stretch, the smallest period
    new[1:] = (runs[0, 1:] != runs[0, :-1]) | (runs[1, 1:] != runs[1, :-1])
    return *runs[:, new], starts


def made_periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document, by checksum of its id, are made to recur from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * ((n - a) // p + 1))[:n - a]


COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _described(texts: list[list[bytes]]) -> Iterator[tuple]:
    """COLUMNS of each document."""
    start, end, period, places = find_runs(texts)
    cover = np.zeros(int(places[-1]) + len(texts[-1]) + 2, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, end, -1)
    gone = np.cumsum(cover) > 0
    bounds = np.searchsorted(start, np.append(places, len(cover)))
    for words, place, a, b in zip(texts, places.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if a == b:
            yield 0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()
            continue
        s, length, p = start[a:b] - place, end[a:b] - start[a:b], period[a:b]
        order = np.lexsort((p, s))
        lines = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s[order].tolist(), length[order].tolist(), p[order].tolist(), strict=True))
        best = np.lexsort((p, s, -length))[0]
        kept = [w for w, g in zip(words, gone[place:place + len(words)].tolist(), strict=True) if not g]
        yield (b - a, int(s[best]), int(length[best]), int(p[best]), int(1000 * length[best] // p[best]),
               hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per run: key, start, length (in words), period."""
    def rows(keys: list, texts: list[list[bytes]]) -> pd.DataFrame:
        start, end, period, places = find_runs(texts)
        doc = np.searchsorted(places, start, "right") - 1
        return pd.DataFrame({"k": pd.Series(keys, dtype=object).iloc[doc].array, "start": start - places[doc], "length": end - start, "period": period})

    return _packed(docs, key, text, "start long, length long, period long", lambda words, _: words, rows)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", damage=made_periodic) -> DataFrame:
    """One row per document: its number of runs, its longest run, and digests of all runs and of the text without repetitions."""
    names = ["k", *[c.split()[0] for c in COLUMNS.split(", ")]]

    def rows(keys: list, texts: list[list[bytes]]) -> pd.DataFrame:
        out = pd.DataFrame([(k, *r) for k, r in zip(keys, _described(texts), strict=True)], columns=names)
        return out.astype({c: "Int64" for c in ("start", "length", "period", "exponent_milli")}).astype({"k": object})

    return _packed(docs, key, text, COLUMNS, damage, rows)


def _packed(docs: DataFrame, key: str, text: str, schema: str, damage, rows) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts, held = [], [], 0
            for k, t in zip(batch["k"].array, batch["t"], strict=True):
                k = None if pd.isna(k) else int(k) if numeric else k
                words = damage(("" if t is None else t).encode("utf-8").split(), k)
                keys.append(k)
                texts.append(words)
                held += len(words)
                if held >= PACK:
                    yield rows(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield rows(keys, texts)

    kind = docs.schema[key].dataType.simpleString()
    numeric = kind in ("bigint", "int")
    slim = docs.selectExpr(f"cast(`{key}` as string) as k" if numeric else f"`{key}` as k", f"`{text}` as t")
    return slim.mapInPandas(work, f"k {kind}, {schema}").withColumnRenamed("k", key)

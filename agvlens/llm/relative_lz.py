"""Substring dedup through relative Lempel-Ziv parsing: documents are factored against blocks of documents with smaller ids.

Every window of ``WINDOW`` words has an anchor, the least of its ``SEED``-word pieces by hash (the first of equal ones). Windows in a row
that share an anchor make a block; equal windows have equal anchors, so the index over blocks by anchor misses none. All documents
are indexed: a distinct block once, with the smallest document that holds it. A document is read from left to right, block by block:

* a block that the index has from a smaller document is copied from there whole;
* elsewhere the document parts from each single reference inside the block, and a factor ends there. At these boundaries the windows
  are looked up one by one, among the windows of all blocks that have the same anchor but differ.

Windows that follow each other in the document and in the reference join to one factor, however many blocks it crosses. Factors have
``WINDOW`` words or more, and their words go. Since each step looks up exact words (two 64-bit hashes of different kinds must both agree), the
words removed are those of all windows that also start in a smaller document.

Only anchors, five or so for a hundred words, are shuffled for all documents; windows only where blocks differ, and each distinct block's
once. Counts combine before every shuffle, so a passage that very many documents share is a handful of rows behind it, and there is no pair of documents
anywhere. The text is shuffled once, of documents that share blocks (a bit map of ``MAP_BITS`` bits, whatever the size, keeps most others back, and
never one that does), and a second time of those with boundaries in them.

Defined cases: a null or blank text has no words; a null doc_id is neither smaller nor larger than another, so such documents keep all and
take nothing; equal doc_ids take nothing from each other; repeated rows get equal results; an empty table gives an empty table; other columns are left
out. A text is read whole, in memory that grows with its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, maybe_in, written

WINDOW = 50
SEED = 10
PACK = 150_000  # words that are hashed together
MAP_BITS = 26  # 8 MB

_WRAP = 1 << 64
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd: of anchors, of windows and blocks
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    for m in _MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any stretch of words, from sums of the words' hashes times powers of a base."""

    powers: dict[int, np.ndarray] = {}

    def __init__(self, words: np.ndarray, base: int):
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self._powers(base, len(words)), dtype=np.uint64, out=self.sums[1:])
        self.back = self._powers(pow(base, -1, _WRAP), len(words) + 1)

    @classmethod
    def _powers(cls, base: int, n: int) -> np.ndarray:
        known = cls.powers.get(base)
        if known is None or len(known) < n:
            known = np.full(max(n, 2 * PACK), base, np.uint64)
            known[0] = 1
            known = cls.powers[base] = np.cumprod(known, dtype=np.uint64)
        return known[:n]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def _hashed(texts: list[list[bytes]]) -> np.ndarray:
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
    return np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[ids]


def blocks(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its blocks in order: (place of the anchor, windows before it and windows in all, packed), anchor, content."""
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(lengths) - lengths
    if lengths.max(initial=0) < WINDOW:
        return [(np.zeros(0, np.int64),) * 3 for _ in texts]
    words = _hashed(texts)
    seeds, content = (Rolling(words, b) for b in _BASES)
    at = np.arange(len(words) - SEED + 1)
    order = seeds.of(at, at + SEED)
    span = WINDOW - SEED + 1
    least = np.arange(len(words) - WINDOW + 1) + np.lib.stride_tricks.sliding_window_view(order, span).argmin(axis=1)
    many = np.maximum(lengths - WINDOW + 1, 0)
    doc = np.repeat(np.arange(len(texts)), many)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + begins[doc]
    anchor = least[start]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    y, x, d = start[first], anchor[first], doc[first]
    shape = ((x - y) << 6) | (count - 1)
    inside = content.of(y, y + count + WINDOW - 1) ^ _mixed(shape.astype(np.uint64) + np.uint64(1))
    packed = ((x - begins[d]) << 12) | shape
    cuts = np.searchsorted(d, np.arange(1, len(texts)))
    return list(zip(*(np.split(a, cuts) for a in (packed, order[x].view(np.int64), inside.view(np.int64))), strict=True))


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the anchor, first window, number of windows."""
    x = at >> 12
    return x, x - ((at >> 6) & 63), (at & 63) + 1


def _windows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some blocks: which block, and where the window starts."""
    _, y, n = _unpacked(at)
    block = np.repeat(np.arange(len(at)), n)
    return block, y[block] + np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)


def parsed(start: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray) -> np.ndarray:
    """Factors (start, length, ref_doc, ref_start) from windows with their references, read from left to right."""
    order = np.argsort(start, kind="stable")
    start, ref_doc, ref_start = start[order], ref_doc[order], ref_start[order]
    on = (np.diff(start) == 1) & (ref_doc[1:] == ref_doc[:-1]) & (np.diff(ref_start) == 1)
    first = np.flatnonzero(np.append(True, ~on)) if len(start) else np.zeros(0, np.int64)
    windows = np.diff(np.append(first, len(start)))
    return np.stack([start[first], windows + WINDOW - 1, ref_doc[first], ref_start[first]], axis=1)


def _words(text: str | None) -> list[bytes]:
    return ("" if text is None else text).encode("utf-8").split()


def _finished(words: list[bytes], factors: np.ndarray, texts: bool) -> tuple:
    """The values of ``_DONE``."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, factors[:, 0], 1)
    np.add.at(edge, factors[:, 0] + factors[:, 1], -1)
    gone = np.cumsum(edge)[:-1] > 0
    kept = b" ".join(words if not len(factors) else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    return int(gone.sum()), hashlib.sha256(kept).hexdigest(), factors.tolist(), kept.decode("utf-8") if texts else None


_DONE = {"n_removed": pa.int64(), "kept_sha256": pa.string(), "factors": pa.list_(pa.list_(pa.int64())), "kept": pa.string()}
_DONE_SCHEMA = "n_removed long, kept_sha256 string, factors array<array<long>>, kept string"
_NOTHING = np.zeros(0, np.int64)


def _done_columns(rows: list[tuple]) -> dict[str, pa.Array]:
    return {c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(_DONE.items())}


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([_NOTHING, *parts])))


def _rows_of(column: pa.ListArray) -> list[np.ndarray]:
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows with their words, ``PACK`` words or one row more at a time."""
    for batch in batches:
        a, texts, held = 0, [], 0
        for i, t in enumerate(batch.column("text")):
            texts.append(_words(t.as_py()))
            held += len(texts[-1])
            if held >= PACK or i == len(batch) - 1:
                yield batch.slice(a, i + 1 - a), texts
                a, texts, held = i + 1, [], 0


def _index(rows: DataFrame, texts: bool) -> DataFrame:
    """Each document's own blocks, and its result if nothing is taken from it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros((0, 4), np.int64)
        for part, words in _packs(batches):
            found = blocks(words)
            columns = {c: part.column(c) for c in ("id", "td")} | {"n_words": pa.array([len(w) for w in words], pa.int64())}
            columns |= _done_columns([_finished(w, none, texts) for w in words])
            yield pa.RecordBatch.from_pydict(columns | {c: _lists([b[i] for b in found]) for i, c in enumerate(("at", "anchor", "content"))})

    return rows.mapInArrow(work, f"id string, td long, n_words long, {_DONE_SCHEMA}, at array<long>, anchor array<long>, content array<long>")


def _shared(index: DataFrame) -> DataFrame:
    """(doc, td, at, anchor, asks, ref_doc, ref_at): blocks that a smaller document holds, with where; without, blocks to be looked into."""
    occurring = index.filter("id is not null").select(
        F.col("id").cast("long").alias("doc"), "td", F.explode(F.arrays_zip("at", "anchor", "content")).alias("b")).select("doc", "td", "b.*")
    often = occurring.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("anchor")
    often = written(often, "lz-often")  # as a table of its own, so that the rows of a hot anchor can be split in the join
    live = written(occurring.join(often, "anchor", "left_semi"), "lz-live")
    owners = live.groupBy("anchor", "content").agg(F.min("doc").alias("ref_doc"), F.min_by("at", "doc").alias("ref_at"), F.max("doc").alias("hi"))
    owners = written(owners, "lz-owners")
    differing = owners.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("ref_doc").alias("lo")).filter("n > 1").select("anchor", "lo", F.lit(True).alias("differing"))
    differing = written(differing, "lz-differing")
    useful = owners.join(differing, "anchor", "left").filter("hi > ref_doc or differing").drop("hi")
    placed = live.join(useful, ["anchor", "content"])
    whole = F.col("ref_doc") < F.col("doc")
    # blocks of an anchor's smallest document are looked up by others, and have nothing to look up themselves
    return placed.filter(whole | F.col("differing")).select(
        "doc", "td", "at", "anchor", (F.col("doc") > F.col("lo")).alias("asks"), F.when(whole, F.col("ref_doc")).alias("ref_doc"), F.when(whole, F.col("ref_at")).alias("ref_at"))


def _looked_into(rows: DataFrame, shared: DataFrame, texts: bool) -> DataFrame:
    """Documents that share blocks: finished if all these are whole, else with their text and the windows to be looked up."""
    block = F.struct("at", "anchor", "asks", "ref_doc", "ref_at")
    listed = shared.groupBy("doc", "td").agg(F.collect_set(block).alias("b"))  # a set, as rows may be repeated
    whole, rims = F.filter("b", lambda b: b["ref_doc"].isNotNull()), F.filter("b", lambda b: b["ref_doc"].isNull())
    field = lambda blocks, name: F.transform(blocks, lambda b: b[name])
    listed = listed.select("doc", "td", *[field(whole, c).alias(c) for c in ("at", "ref_doc", "ref_at")], field(rims, "at").alias("rim"), field(rims, "anchor").alias("rim_anchor"),
                           F.transform(rims, lambda b: b["asks"].cast("long")).alias("rim_asks"))
    listed = written(listed, "lz-listed")
    place = F.xxhash64("doc", "td")
    kept = rows.sparkSession.sparkContext.broadcast(bit_map(listed, place, MAP_BITS))
    known = rows.filter("id is not null").withColumn("doc", F.col("id").cast("long")).drop("id").filter(maybe_in(place, kept, MAP_BITS))
    joined = known.join(listed, ["doc", "td"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ("at", "ref_doc", "ref_at", "rim", "rim_anchor", "rim_asks")
        for part, all_words in _packs(batches):
            hashed, begin, done = None, 0, []
            out: dict[str, list[np.ndarray]] = {c: [] for c in (*_WINDOWS, *_RIMS)}
            has_rim = []
            for words, at, ref_doc, ref_at, rim, rim_anchor, rim_asks in zip(all_words, *[_rows_of(part.column(c)) for c in lists], strict=True):
                b, start = _windows_of(at)
                windows = start, ref_doc[b], start + ((ref_at >> 12) - (at >> 12))[b]
                has_rim.append(len(rim) > 0)
                if len(rim):
                    hashed = Rolling(_hashed(all_words), _BASES[1]) if hashed is None else hashed
                    b, y = _windows_of(rim)
                    rims = rim_anchor[b], y, hashed.of(begin + y, begin + y + WINDOW).view(np.int64), rim_asks[b]
                    done.append((None,) * len(_DONE))
                else:
                    rims = (_NOTHING,) * len(_RIMS)
                    done.append(_finished(words, parsed(*windows), texts))
                for c, values in zip(out, (*windows, *rims), strict=True):
                    out[c].append(values)
                begin += len(words)
            text = pa.array([t.as_py() if rim else None for t, rim in zip(part.column("text"), has_rim, strict=True)], pa.string())
            yield pa.RecordBatch.from_pydict({"doc": part.column("doc"), "td": part.column("td"), "text": text} | {c: _lists(v) for c, v in out.items()} | _done_columns(done))

    schema = f"doc long, td long, text string, {', '.join(f'{c} array<long>' for c in (*_WINDOWS, *_RIMS))}, {_DONE_SCHEMA}"
    return joined.select("doc", "td", "text", "at", "ref_doc", "ref_at", "rim", "rim_anchor", "rim_asks").mapInArrow(work, schema)


_WINDOWS, _RIMS = ("start", "ref_doc", "ref_start"), ("rim_anchor", "rim_start", "rim_window", "rim_asks")


def _at_boundaries(looked: DataFrame) -> DataFrame:
    """(doc, td, found): the windows at boundaries that a smaller document holds, with where."""
    zipped = F.arrays_zip(F.col("rim_anchor").alias("anchor"), F.col("rim_start").alias("start"), F.col("rim_window").alias("window"), F.col("rim_asks").alias("asks"))
    windows = looked.filter("text is not null").select("doc", "td", F.explode(zipped).alias("w")).select("doc", "td", "w.*")
    least = windows.groupBy("anchor", "window").agg(F.min("doc").alias("ref_doc"), F.min_by("start", "doc").alias("ref_start"), F.max("doc").alias("hi")).filter("hi > ref_doc")
    least = written(least, "lz-windows")
    known = windows.filter("asks = 1").drop("asks").join(least.drop("hi"), ["anchor", "window"]).filter("ref_doc < doc").select("doc", "td", "start", "ref_doc", "ref_start").distinct()
    return known.groupBy("doc", "td").agg(F.collect_list(F.struct("start", "ref_doc", "ref_start")).alias("found"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """key, n_words, n_removed, kept_sha256, factors (start, length, ref_doc, ref_start) and, with ``texts``, the ``kept`` words."""
    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.xxhash64(body).alias("td"), body.alias("text"))
    index = written(_index(rows, texts), "lz-index")
    looked = written(_looked_into(rows, _shared(index.select("id", "td", "at", "anchor", "content")), texts), "lz-looked")
    found = _at_boundaries(looked)
    field = lambda name: F.coalesce(F.transform("found", lambda b: b[name]), F.array().cast("array<long>")).alias(f"more_{name}")
    open_docs = looked.filter("text is not null").select("doc", "td", "text", *_WINDOWS).join(found, ["doc", "td"], "left").select(
        "doc", "td", "text", *_WINDOWS, *[field(c) for c in _WINDOWS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, all_words in _packs(batches):
            lists = zip(*[_rows_of(part.column(c)) for c in (*_WINDOWS, *(f"more_{c}" for c in _WINDOWS))], strict=True)
            done = [_finished(words, parsed(*(np.concatenate([x[i], x[i + 3]]) for i in range(3))), texts) for words, x in zip(all_words, lists, strict=True)]
            yield pa.RecordBatch.from_pydict({"doc": part.column("doc"), "td": part.column("td")} | _done_columns(done))

    finished = open_docs.mapInArrow(work, f"doc long, td long, {_DONE_SCHEMA}").unionByName(looked.filter("text is null").select("doc", "td", *_DONE))
    taken = finished.distinct().select(F.col("doc").cast("string").alias("id"), "td", *[F.col(c).alias(f"new_{c}") for c in _DONE])
    kind = docs.schema[key].dataType.simpleString()
    return index.select("id", "td", "n_words", *_DONE).join(taken, ["id", "td"], "left").select(
        F.col("id").cast(kind).alias(key), "n_words", *[F.coalesce(f"new_{c}", c).alias(c) for c in _DONE if texts or c != "kept"])

"""Benchmark decontamination by templates.

Words become template tokens: numbers, units after numbers, and capitalised words within a sentence (words in capitals
throughout aside) turn into typed placeholders, all others are lower-cased and stripped of punctuation. Windows of template tokens are joined by hash with
those of the benchmark, so a question with other numbers and names still meets its original. Windows on one diagonal
(item position minus text position) belong together; there every slot value of the item must stand for one value of the
text, or the diagonal is dropped. Two item values may meet in one text value (new numbers coincide by chance); ``merged`` counts those. A text holds an item if enough of the item's windows are found,
on one diagonal or on neighbouring ones (up to ``drift`` apart) together: words put in or left out move a copy from diagonal to diagonal. Slot values must agree over all
that are added up, and a window of the item counts once.

A bit map of the benchmark's window hashes (2 MB, whatever the benchmark's size) drops windows that cannot join before
the shuffle; it never drops one that can.

Windows with fewer than ``min_literals`` literals say too little as templates. Those of items are looked for as they are instead:
by the hash of their plain lower-cased words, so an exact copy is found whatever its words are, and only the relaxation is limited.

Defined cases: null texts and items have no windows, nor do those without a word; a very long text is read whole, batch by batch; items
shorter than a window are one window of their own length; repeated rows are reported each once per doc_id and text;
empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_digest, whole_row, written

BITMAP_BITS = 24

# Words that are units when a number stands before them.
UNITS = frozenset("""mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec second seconds min minute minutes h hour hours day days week weeks month months
year years meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram
kilograms pound pounds ounce ounces liter liters litre litres dollar dollars euro euros cent cents percent degrees mph""".split())
# Number words.
NUMBER_WORDS = frozenset("two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
EDGE = " \t.,;:!?\"'()[]{}<>«»“”‘’*#|…-–—"
LITERAL, NUM, UNIT, NAME = 0, 1, 2, 3
_MARK = np.array([0, *(xxhash.xxh64_intdigest(f"\0{k}", 1) for k in ("number", "unit", "name"))], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLAIN = np.uint64(xxhash.xxh64_intdigest("\0plain", 1))  # sets hashes of plain words apart from those of templates


@dataclass(frozen=True)
class Matching:
    window: int = 8
    min_literals: int = 4  # words of a window that are no placeholders
    min_share: float = 0.3  # of an item's windows
    drift: int = 8  # between diagonals that are added up: words put in or left out at one place


class Words:
    """Numbers words and remembers what they can be; emptied when large."""

    LIMIT = 300_000

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.hash = np.zeros(1 << 14, np.uint64)
        self.kind = np.zeros(1 << 14, np.uint8)  # bit 0 number, 1 unit, 2 capitalised, 3 ends a sentence, 4 has no characters

    def index(self, word: str) -> int:
        if (i := self.number.get(word)) is None:
            plain = word.strip(EDGE)
            low = plain.lower()
            kind = int(NUMBER.fullmatch(plain) is not None or low in NUMBER_WORDS) | 2 * (low in UNITS) | 16 * (low == "")
            kind |= 4 * (plain[:1].isupper() and not plain.isupper()) | 8 * word.rstrip("\"')]»”’").endswith((".", "!", "?", ":"))
            i = self.number[word] = len(self.text)
            self.text.append(low)
            if i == len(self.kind):
                self.hash, self.kind = np.resize(self.hash, 2 * i), np.resize(self.kind, 2 * i)
            self.hash[i], self.kind[i] = xxhash.xxh64_intdigest(low, 0), kind
        return i


def tokens(text: str, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, token types and token hashes of a text; tokens that are nothing but punctuation are left out."""
    lines = [line.split() for line in text.split("\n")]
    ids = np.fromiter((words.index(w) for line in lines for w in line), np.int64)
    first = np.zeros(len(ids) + 1, bool)
    first[np.cumsum([0, *map(len, lines)])] = True  # starts of lines
    kind = words.kind[ids]
    begins = first[:-1].copy()
    begins[1:] |= (kind[:-1] & 8) > 0
    solid = (kind & 16) == 0
    ids, kind, begins = ids[solid], kind[solid], begins[solid]
    number = (kind & 1) > 0
    after = np.zeros(len(ids), bool)
    after[1:] = number[:-1]
    types = np.where(number, NUM, np.where(((kind & 2) > 0) & after, UNIT, np.where(((kind & 4) > 0) & ~begins, NAME, LITERAL)))
    return ids, types, np.where(types == LITERAL, words.hash[ids], _MARK[types])


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(hashes) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * _BASE + (hashes[k:k + n] ^ (hashes[k:k + n] >> np.uint64(29)))
    h ^= h >> np.uint64(32)
    return h * _BASE


def _literals(types: np.ndarray, size: int) -> np.ndarray:
    """The literals of each window."""
    run = np.concatenate([[0], np.cumsum(types == LITERAL)])
    return run[size:] - run[:max(0, len(types) - size + 1)]


def window_hashes(hashes: np.ndarray, types: np.ndarray, size: int, min_literals: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows of ``size`` tokens that have enough literals."""
    at = np.flatnonzero(_literals(types, size) >= min_literals)
    return at, _rolled(hashes, size)[at]


_WINDOWS = "id {}, r long, len int, exact boolean, total int, whole int, pos long, h long, slots array<string>"


def _windows(rows: DataFrame, key: str, text: str, matching: Matching, lengths: list[tuple[int, bool]] | None, bitmap) -> DataFrame:
    """Windows of a table. ``lengths`` None: of items, each of its own length at most, those with too few literals ``exact``;
    else those of texts, sieved, by length and whether exact. total: the item's templates; whole: all its windows."""
    kind = rows.schema[key].dataType.simpleString()
    slim = rows.select(F.col(f"`{key}`").alias("id"), row_digest([key, text]).alias("r"), F.col(f"`{text}`").alias("t")).filter("t is not null")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        sieve = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            out: list[tuple] = []
            for row_id, r, t in zip(batch["id"], batch["r"], batch["t"], strict=True):
                if len(words.text) > Words.LIMIT:
                    words.clear()
                ids, types, hashes = tokens(t, words)
                size = min(matching.window, len(ids))
                own = [(size, False), (size, True)] if lengths is None else lengths
                for size, exact in own:
                    if size < 1 or (size < matching.min_literals and not exact):
                        continue
                    if exact:
                        h = _rolled(words.hash[ids] ^ _PLAIN, size)
                        at = np.arange(len(h)) if lengths is not None else np.flatnonzero(_literals(types, size) < matching.min_literals)
                        h = h[at]
                    else:
                        at, h = window_hashes(hashes, types, size, matching.min_literals)
                    whole = max(0, len(ids) - size + 1)
                    total = whole - len(at) if exact else len(at)  # of templates
                    if sieve is not None and len(at):
                        bit = h >> np.uint64(64 - BITMAP_BITS)
                        passed = (sieve[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        at, h = at[passed], h[passed]
                    for p, x in zip(at.tolist(), h.astype(np.int64).tolist(), strict=True):
                        slots = [] if exact else [f"{types[i]}{words.text[ids[i]]}" for i in range(p, p + size) if types[i]]
                        out.append((row_id, r, size, exact, total, whole, p, x, slots))
            yield pd.DataFrame(out, columns=["id", "r", "len", "exact", "total", "whole", "pos", "h", "slots"])

    return slim.mapInPandas(work, _WINDOWS.format(kind))


def _bitmap(items: DataFrame) -> bytes:
    """The bit map of window hashes; the driver gets its words, a fixed number at most."""
    bit = F.shiftrightunsigned("h", 64 - BITMAP_BITS)
    sets = items.select(F.shiftright(bit, 6).alias("w"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - BITMAP_BITS}) & 63))").alias("b"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in sets.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[r["w"]] = r["b"]
    return out.tobytes()


def leaks(docs: DataFrame, benchmark: DataFrame, matching: Matching = Matching(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each text and item it holds: key, item_id, share of the item's windows, first and last word, whether
    slot values differ (``changed``), how many item values met in another's text value (``merged``), and the row digest ``r``."""
    items = written(_windows(benchmark, "item_id", "text", matching, None, None), "template-items")
    lengths = sorted(tuple(r) for r in items.select("len", "exact").distinct().collect())  # at most twice ``window`` pairs
    if not lengths:
        lengths = [(matching.window, False)]
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(items))
    found = _windows(docs, key, text, matching, lengths, bitmap)
    own = items.select(F.col("id").alias("item_id"), F.col("r").alias("item_r"), "len", "exact", "h", F.col("total").alias("wanted"), F.col("whole").alias("all"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    pairs = found.drop("total", "whole").join(own, ["len", "exact", "h"]).withColumn("diagonal", F.col("item_pos") - F.col("pos"))
    # one diagonal has a window per item position at most, so what is gathered is no longer than the item
    text_item = ["id", "r", "item_id", "item_r", "wanted", "all", "len"]
    slots = F.collect_set(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("t")))
    found_at = F.collect_set(F.struct(F.col("item_pos").alias("p"), F.col("exact").alias("e")))
    diagonals = pairs.groupBy(*text_item, "diagonal").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), found_at.alias("at"), F.array_distinct(F.flatten(slots)).alias("slots"))
    values = lambda f: F.size(F.array_distinct(F.transform("slots", lambda s: s[f])))
    steady = diagonals.filter(values("i") == F.size("slots"))
    # diagonals of one text and item, those that lie close together numbered alike
    near = Window.partitionBy("id", "r", "item_id", "item_r", "len").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(near) > matching.drift, F.lit(False))
    numbered = steady.withColumn("apart", apart.cast("int")).withColumn("band", F.sum("apart").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    # sets of single windows and slots: no larger than the item, however many diagonals a text that repeats itself has
    none = lambda kind: F.lit(None).cast(kind)
    single = F.concat(
        F.transform("at", lambda w: F.struct(w.alias("at"), none("struct<i:string,t:string>").alias("slot"))),
        F.transform("slots", lambda s: F.struct(none("struct<p:bigint,e:boolean>").alias("at"), F.struct(s["i"].alias("i"), s["t"].alias("t")).alias("slot"))))
    bands = numbered.select(*text_item, "band", "diagonal", "first", "last", F.explode(single).alias("x")).groupBy(*text_item, "band").agg(
        (F.max("diagonal") > F.min("diagonal")).alias("several"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.collect_set("x.at").alias("at"), F.collect_set("x.slot").alias("slots"))
    together = bands.filter(F.col("several") & (values("i") == F.size("slots")))
    each = [*text_item, "first", "last", "at", "slots"]
    # of the templates, or of all windows, whichever is more: exact windows add to what is found and take nothing away
    n, n_template = F.size("at"), F.size(F.filter("at", lambda w: ~w["e"]))
    share = F.greatest(F.when(F.col("wanted") > 0, n_template / F.col("wanted")), n / F.col("all"))
    steady = steady.select(*each).unionByName(together.select(*each)).withColumn("share", share).filter(
        F.col("share") >= matching.min_share).withColumn("merged", F.size("slots") - values("t"))
    best = F.max(F.struct(F.col("share"), (-F.col("first")).alias("early"), (F.col("last") + F.col("len") - 1).alias("last"),
                          F.exists("slots", lambda s: s["i"] != s["t"]).alias("changed"), F.col("merged")))
    return steady.groupBy("id", "r", "item_id").agg(best.alias("b")).select(
        F.col("id").alias(key), "item_id", F.round("b.share", 4).alias("share"), (-F.col("b.early")).alias("first_word"),
        F.col("b.last").alias("last_word"), F.col("b.changed").alias("changed"), F.col("b.merged").alias("merged"), "r")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, matching: Matching = Matching()) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with."""
    bad = written(leaks(docs, benchmark, matching).select("doc_id", "r").distinct(), "template-leaks")
    own = docs.select(whole_row(docs), row_digest(["doc_id", "text"]).alias("r"))
    same = (F.col("own.r") == F.col("bad.r")) & F.col("own.doc.doc_id").eqNullSafe(F.col("bad.doc_id"))
    return own.alias("own").join(bad.alias("bad"), same, "left_anti").select("doc.*")

"""Conversation structure repair through Four-Russians block tables.

A conversation shall read ``(s?(ua)+)?`` in its role initials. Edits: Keep 0, Rerole (to user or assistant) 1, Delete 2,
Insert (an empty user or assistant turn, anywhere) 5; a blank or repeated row must be deleted, a truncated one that stays costs 5 more.

The cheapest edits are paths through four states. The costs to go, taken relative to their least, form a small set of vectors, so the
step from one vector to the one before it is tabulated for every block of ``BLOCK`` symbols: a conversation is read from its end, block
by block, by lookup. Blocks are then opened in reading order, each backward from the vector at its right end, and the least letter that
keeps the cost is taken at every row, which settles ties: the edits' initials are the least in ASCII order.

No conversation has to fit into a task. Rows that agree in everything are counted before any shuffle; distinct ones get their places by a range
partitioning and are cut into slices of up to 2^``SLICE_BITS`` places. Slices of a conversation that has several are first reduced to the
costs between entry and exit states; those are chained in a stream over slices, from the end for the costs, from the start for the states.
Texts are shuffled once, to be read in order: that stream holds one text, a hash state and the edits' initials.

Defined cases: a null conv_id, turn, role or text reads as one space (a null conv_id is one conversation, null turns come first and count for no
gap); equal turns are ordered by role, then by a digest of the text; of equal rows all but the first are duplicates; a role counts by its
first character and is kept as it is; very long texts pass through whole; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_SITE, written

BLOCK = 4
SLICE_BITS = 12

# The symbols are "must go", then the classes s, u, a, other, sound or truncated.
GONE, CLASSES, SYMBOLS = 0, "sua", 9
KEEP, REROLE, DELETE, INSERT, STUMP = 0, 1, 2, 5, 5
# States: nothing yet, after s, after u, after a. The one user or assistant turn that may follow each:
FOLLOWS = (2, 2, 3, 2)
ENDS = (0, 2, 1, 0)  # inserts that end a conversation in each state
FAR = 1 << 40  # no way


def _closed(costs: list[int]) -> list[int]:
    """Costs to go where inserts may come first."""
    c = list(costs)
    for q in (2, 3, 0, 1):
        c[q] = min(c[q], INSERT + c[FOLLOWS[q]])
    return c


def _kept(symbol: int, q: int) -> int | None:
    """The state after keeping a row, None if its role does not fit."""
    letter = (symbol - 1) % 4
    if letter == 0:
        return 1 if q == 0 else None
    return FOLLOWS[q] if letter + 1 == FOLLOWS[q] else None


def _before(symbol: int, after: list[int]) -> list[int]:
    """Costs to go before a row, from those after it."""
    costs = []
    for q in range(4):
        ways = [DELETE + after[q]]
        if symbol != GONE:
            more = STUMP if symbol > 4 else 0
            ways.append(more + REROLE + after[FOLLOWS[q]])
            if (to := _kept(symbol, q)) is not None:
                ways.append(more + KEEP + after[to])
        costs.append(min(ways))
    return _closed(costs)


def _normal(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(min(c - least, FAR) if c < FAR // 2 else FAR for c in costs), least


class Tables:
    """All vectors that occur, and for each one and every block the vector before it with the cost between."""

    def __init__(self) -> None:
        starts = [[0, FAR, FAR, 0], *[[0 if q == p else FAR for q in range(4)] for p in range(4)]]
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.starts = []
        for s in starts:
            v, least = _normal(_closed(s))
            self.starts.append((self._add(v), least))
        step, cost = [], []
        for v in self.vectors:  # grows meanwhile
            reached = [_normal(_before(s, list(v))) for s in range(SYMBOLS)]
            step.append([self._add(r) for r, _ in reached])
            cost.append([c for _, c in reached])
        self.one, self.one_cost = step, cost
        table, total = np.arange(len(step))[:, None], np.zeros((len(step), 1), np.int64)
        single, single_cost = np.array(step), np.array(cost)
        for _ in range(BLOCK):  # one more symbol to the left, the most significant digit
            total = (total[:, None, :] + single_cost[table].transpose(0, 2, 1)).reshape(len(step), -1)
            table = single[table].transpose(0, 2, 1).reshape(len(step), -1)
        self.block, self.block_cost = table.tolist(), total.tolist()
        self.opened: dict[tuple, tuple[tuple[str, ...], int]] = {}

    def _add(self, v: tuple[int, ...]) -> int:
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v]

    def back(self, symbols: list[int], end: int) -> tuple[list[int], int]:
        """The vectors at the left end of each block, last one the given ``end``, and the cost passed."""
        v, passed, seen = end, 0, [end]
        whole = len(symbols) - len(symbols) % BLOCK
        for s in reversed(symbols[whole:]):
            passed += self.one_cost[v][s]
            v = self.one[v][s]
        if whole < len(symbols):
            seen.append(v)
        for i in range(whole - BLOCK, -1, -BLOCK):
            code = 0
            for s in symbols[i:i + BLOCK]:
                code = code * SYMBOLS + s
            passed += self.block_cost[v][code]
            v = self.block[v][code]
            seen.append(v)
        return seen[::-1], passed

    def open(self, block: tuple[int, ...], end: int, q: int) -> tuple[tuple[str, ...], int]:
        """Edits of each row of a block and the state behind it; rows of one block recur, so what was opened is kept."""
        key = (block, end, q)
        if key not in self.opened:
            costs = [list(self.vectors[end])]
            for s in reversed(block):
                costs.append(_before(s, costs[-1]))
            costs.reverse()
            edits = []
            for j, s in enumerate(block):
                now, after, done, more = costs[j], costs[j + 1], "", STUMP if s > 4 else 0
                while True:
                    if now[q] == DELETE + after[q]:
                        done += "D"
                        break
                    if now[q] == INSERT + now[FOLLOWS[q]]:
                        done, q = done + "I", FOLLOWS[q]
                        continue
                    to = _kept(s, q)
                    if to is not None and now[q] == more + KEEP + after[to]:
                        done, q = done + "K", to
                    else:
                        done, q = done + "R", FOLLOWS[q]
                    break
                edits.append(done)
            self.opened[key] = tuple(edits), q
        return self.opened[key]

    def trace(self, symbols: list[int], end: int, q: int) -> tuple[list[str], int]:
        """Edits of all rows from state ``q`` on, and the state behind the last."""
        vectors, edits = self.back(symbols, end)[0], []
        for i, v in zip(range(0, len(symbols), BLOCK), vectors[1:], strict=True):
            done, q = self.open(tuple(symbols[i:i + BLOCK]), v, q)
            edits += done
        return edits, q

    def between(self, symbols: list[int]) -> list[int]:
        """Least costs from each entry state to each exit state, entry by entry; FAR where there is no way."""
        columns = []
        for v, least in self.starts[1:]:
            seen, passed = self.back(symbols, v)
            columns.append([FAR if c >= FAR // 2 else c + passed + least for c in self.vectors[seen[0]]])
        return [columns[r][q] for q in range(4) for r in range(4)]

    def earlier(self, between: Iterable[int], end: int) -> int:
        """The vector before a slice, from the one behind it."""
        ways, after = list(between), self.vectors[end]
        return self.number[_normal(_closed([min(min(ways[4 * q + r] + after[r], FAR) for r in range(4)) for q in range(4)]))[0]]


@cache
def tables() -> Tables:
    return Tables()


ACCEPT = 0  # the number of the vector at the end of a conversation


def damaged(conversations: DataFrame) -> DataFrame:
    """ck (conv_id as text), turn, role, text, copies: the rows after the damage."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(NO_SITE)).alias("ck"), F.col("turn").cast("long").alias("turn"), as_text("role").alias("role"),
        as_text("text").alias("text"), (F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20).alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    return rows.filter("fate <> 0").select("ck", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


def _order() -> list:
    """Arrival within conversations: by turn, nulls first; ties by role, then by the text's digest."""
    return [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("da"), F.col("db")]


def _digested(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"da": F.xxhash64("text"), "db": F.xxhash64(F.lit(1), "text")})


def places(rows: DataFrame) -> DataFrame:
    """One row for each distinct row of ``rows``: its place ``at``, its copies ``n``, its symbol; written once."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    first = F.substring("role", 1, 1)
    kind = F.lit(len(CLASSES))
    for i, letter in enumerate(CLASSES):
        kind = F.when(first == letter, i).otherwise(kind)
    marked = _digested(rows).select("ck", "turn", "role", "da", "db", "copies", (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("stump"), kind.alias("kind"))
    distinct = marked.groupBy("ck", "turn", "role", "da", "db", "blank", "stump", "kind").agg(F.sum("copies").alias("n"))
    order = _order()
    placed = written(distinct.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "turns-places")
    said = placed.groupBy("ck", "role", "da", "db").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    again = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    symbol = F.when(F.col("blank") | again, GONE).otherwise(1 + F.col("kind") + 4 * F.col("stump").cast("int"))
    return placed.join(said, ["ck", "role", "da", "db"], "left").withColumns({"symbol": symbol, "slice": F.shiftright("at", SLICE_BITS)}).drop("first")


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole slices (equal ck and slice, in order) and where each begins, the length last."""
    rest = None
    def starts(t: pa.Table) -> list[int]:
        new = pc.or_(pc.not_equal(t["ck"][1:], t["ck"][:-1]), pc.not_equal(t["slice"][1:], t["slice"][:-1]))
        return [0, *(np.flatnonzero(new.to_numpy()) + 1).tolist(), len(t)]
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not len(t):
            continue
        cuts = starts(t)
        rest = t.slice(cuts[-2])
        if len(cuts) > 2:
            yield t.slice(0, cuts[-2]), cuts[:-1]
    if rest is not None:
        yield rest, starts(rest)


def _by_slice(df: DataFrame, schema: str, work) -> DataFrame:
    """``work(table, starts)`` over tables of whole slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _slices(batches):
            yield from work(t, starts).to_batches()

    return df.repartition("ck", "slice").sortWithinPartitions("ck", "slice", "at").mapInArrow(run, schema)


def _chained(df: DataFrame, schema: str, backward: bool, step) -> DataFrame:
    """A stream over the slices of each conversation; ``step(row, state)`` gives the output row and the next state."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ck, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.ck != ck:
                    ck, state = row.ck, None
                made, state = step(row, state)
                out.append(made)
            if out:
                yield pd.DataFrame(out)

    slices = F.col("slice").desc() if backward else F.col("slice")
    return df.repartition("ck").sortWithinPartitions("ck", slices).mapInPandas(run, schema)


def _bounds(symbols: DataFrame) -> DataFrame:
    """For each slice of conversations that have several: the vector behind it, the state before it, and if it is the last."""
    several = symbols.groupBy("ck").agg(F.min("slice").alias("lo"), F.max("slice").alias("hi")).filter("lo < hi").select("ck")
    crossing = written(symbols.join(several, "ck", "left_semi").select("ck", "slice", "at", "symbol"), "turns-crossing")

    def between(t: pa.Table, starts: list[int]) -> pa.Table:
        all_symbols = t["symbol"].to_pylist()
        heads = t.select(["ck", "slice"]).take(starts[:-1])
        return heads.append_column("costs", pa.array([tables().between(all_symbols[a:b]) for a, b in zip(starts, starts[1:], strict=False)], pa.list_(pa.int64())))

    def from_the_end(row, behind):
        end = ACCEPT if behind is None else behind
        return {"ck": row.ck, "slice": row.slice, "end": end, "last": behind is None}, tables().earlier(row.costs, end)

    costs = _by_slice(crossing, "ck string, slice long, costs array<long>", between)
    ends = written(_chained(costs, "ck string, slice long, end int, last boolean", True, from_the_end), "turns-ends")

    def exits(t: pa.Table, starts: list[int]) -> pa.Table:
        all_symbols, end = t["symbol"].to_pylist(), t["end"].to_pylist()
        ways = [[tables().trace(all_symbols[a:b], end[a], q)[1] for q in range(4)] for a, b in zip(starts, starts[1:], strict=False)]
        return t.select(["ck", "slice", "end", "last"]).take(starts[:-1]).append_column("exits", pa.array(ways, pa.list_(pa.int32())))

    def from_the_start(row, before):
        entry = 0 if before is None else before
        return {"ck": row.ck, "slice": row.slice, "end": row.end, "last": row.last, "entry": entry}, int(row.exits[entry])

    ways = _by_slice(crossing.join(ends, ["ck", "slice"]), "ck string, slice long, end int, last boolean, exits array<int>", exits)
    return written(_chained(ways, "ck string, slice long, end int, last boolean, entry int", False, from_the_start), "turns-bounds")


def edits(symbols: DataFrame) -> DataFrame:
    """``symbols`` (of :func:`places`) with the edits at each place: ``edits`` up to the row's first copy, and ``closing``
    inserts behind the conversation's last row. Further copies of a row are deleted."""
    bounded = symbols.join(_bounds(symbols), ["ck", "slice"], "left").withColumns({
        "end": F.coalesce("end", F.lit(ACCEPT)), "entry": F.coalesce("entry", F.lit(0)), "last": F.coalesce("last", F.lit(True))})

    def work(t: pa.Table, starts: list[int]) -> pa.Table:
        all_symbols, end, entry, last = (t[c].to_pylist() for c in ("symbol", "end", "entry", "last"))
        done, closing = [], []
        for a, b in zip(starts, starts[1:], strict=False):
            made, q = tables().trace(all_symbols[a:b], end[a], entry[a])
            done += made
            closing += [0] * (b - a - 1) + [ENDS[q] if last[a] else 0]
        kept = t.select(["ck", "turn", "role", "da", "db", "at", "n", "symbol", "blank", "kind"])
        return kept.append_column("edits", pa.array(done, pa.string())).append_column("closing", pa.array(closing, pa.int32()))

    return _by_slice(bounded, "ck string, turn long, role string, da long, db long, at long, n long, symbol int, blank boolean, kind int, edits string, closing int", work)


class _Reader:
    """One conversation as it is read in order: the repaired turns, and what the report counts."""

    def __init__(self) -> None:
        self.state, self.before, self.turns = 0, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.hash = hashlib.sha256()

    def take(self, row, text: str | None) -> list[tuple[str, str]]:
        """The turns that a row leaves."""
        n, stump = int(row.n), row.symbol > 4
        self.blank += n if row.blank else 0
        self.duplicate += 0 if row.blank else n if row.symbol == GONE else n - 1
        self.truncated += stump
        pair = (self.before, row.kind)
        self.illegal += n - 1 + (self.before is not None and pair not in ((0, 1), (1, 2), (2, 1)))
        self.before = row.kind
        self.audit += [row.edits, "D" * (n - 1), "I" * row.closing]
        self.cost += DELETE * (n - 1)
        turns = []
        for letter in row.edits + "I" * row.closing:
            if letter == "D":
                self.cost += DELETE
                continue
            to = _kept(row.symbol, self.state) if letter == "K" else FOLLOWS[self.state]
            role = row.role if letter == "K" else ("user", "assistant")[to - 2]
            turns.append((role, "" if letter == "I" else text))
            self.cost += INSERT if letter == "I" else (KEEP if letter == "K" else REROLE) + STUMP * stump
            self.state = to
        for role, said in turns:
            self.hash.update(("\n" if self.turns else "").encode() + f"{role}:{said}".encode())
            self.turns += 1
        return turns


def _read(rows: DataFrame, done: DataFrame, schema: str, rows_of, end_of) -> DataFrame:
    """A stream over each conversation's texts and edits; ``rows_of(ck, reader, turns)`` and ``end_of(ck, reader)`` give rows."""
    texts = _digested(rows.drop("copies"))
    none = lambda kind: F.lit(None).cast(kind)
    told = done.select("ck", "turn", "role", "da", "db", none("string").alias("text"), "at", "n", "symbol", "blank", "kind", "edits", "closing")
    said = texts.select("ck", "turn", "role", "da", "db", "text", *[none(done.schema[c].dataType).alias(c) for c in ("at", "n", "symbol", "blank", "kind", "edits", "closing")])
    both = said.unionByName(told).repartition("ck").sortWithinPartitions(*_order(), F.col("at").asc_nulls_first())
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", "symbol", "kind", "closing")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ck, reader, text = None, None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.ck != ck:
                    out += end_of(ck, reader) if reader else []
                    ck, reader = row.ck, _Reader()
                if row.edits is None:
                    text = row.text
                else:
                    out += rows_of(ck, reader, reader.take(row, text))
            if out:
                yield pd.DataFrame(out)
        if reader and (out := end_of(ck, reader)):
            yield pd.DataFrame(out)

    slim = both.withColumns({**zero, "blank": F.coalesce("blank", F.lit(False))}).select("ck", "role", "text", "n", "symbol", "blank", "kind", "edits", "closing")
    return slim.mapInPandas(run, schema)


def repaired(conversations: DataFrame) -> DataFrame:
    """ck, position, role, text: the turns of all repaired conversations, after the damage."""
    def rows_of(ck, reader, turns):
        first = reader.turns - len(turns)
        return [{"ck": ck, "position": first + i, "role": role, "text": said} for i, (role, said) in enumerate(turns)]

    rows = damaged(conversations)
    return _read(rows, edits(places(rows)), "ck string, position long, role string, text string", rows_of, lambda ck, reader: [])


def report(conversations: DataFrame) -> DataFrame:
    """Every conversation with its faults, the cost and initials of its edits, and the digest of what they leave."""
    def end_of(ck, r):
        return [{"ck": ck, "blank": r.blank, "duplicate": r.duplicate, "truncated": r.truncated, "illegal": r.illegal, "cost": r.cost,
                 "audit": "".join(r.audit), "repaired_sha256": r.hash.hexdigest()}]

    rows = damaged(conversations)
    schema = "ck string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    read = _read(rows, edits(places(rows)), schema, lambda ck, reader, turns: [], end_of)
    gaps = rows.groupBy("ck").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    known = conversations.select("conv_id").distinct().withColumn("ck", F.coalesce(F.col("conv_id").cast("string"), F.lit(NO_SITE)))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return known.join(gaps, "ck", "left").join(read, "ck", "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

"""Tables of a streaming job behind one pointer.

A micro-batch writes a part of each appended table and new versions of the buckets it changes in keyed tables; nothing of
it is seen until the next pointer names them, all at once. Readers take the newest pointer and open what it names, so they see
one version of all tables. Parts are merged by size class, ``fan`` small ones into one larger, so there are few however long the job
has run; what a pointer no longer names stays for ``keep`` more pointers, for readers in the middle of it, and then goes.
A replayed batch writes to the same folders, which no pointer names yet.

One job writes a store; any number of sessions may read it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyarrow.fs import FileSystem
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType

from ..sources.folders import Folder

BATCH = StructField("batch_id", LongType(), True)
DAY = StructField("dt", DateType(), True)
FILE_ROWS = 500_000


class BatchStore:
    def __init__(self, spark: SparkSession, root: str, fan: int = 8, keep: int = 20, filesystem: FileSystem | None = None):
        """``filesystem`` is for addresses that Arrow cannot open by itself, or that need other credentials than Spark's."""
        self.spark, self.root, self.fan, self.keep = spark, root.rstrip("/"), fan, keep
        self.folder = Folder(self.root, filesystem)
        self._parts: dict[str, dict] = {}
        self._buckets: dict[str, dict] = {}

    # -- the pointer ---------------------------------------------------------------------

    def pointer(self) -> dict:
        """What the newest pointer names: the last batch, parts and buckets by table, and what has been replaced."""
        newest = max((int(n) for n in self.folder.names("_pointer") if n.isdigit()), default=None)
        if newest is None:
            return {"n": -1, "batch": -1, "parts": {}, "buckets": {}, "notes": {}, "replaced": []}
        return json.loads(self.folder.text(f"_pointer/{newest}"))

    def _point(self, now: dict) -> None:
        now["n"] += 1
        gone = [r for r in now["replaced"] if r["n"] <= now["n"] - self.keep]
        now["replaced"] = [r for r in now["replaced"] if r["n"] > now["n"] - self.keep]
        self.folder.put(f"_pointer/{now['n']}", json.dumps(now))
        for r in gone:
            self.folder.remove(r["path"])
        for n in self.folder.names("_pointer"):
            if n.isdigit() and int(n) <= now["n"] - self.keep:
                self.folder.remove(f"_pointer/{n}")

    def last_committed(self) -> int:
        """The newest committed batch, -1 before the first. Batches commit in order."""
        return self.pointer()["batch"]

    def note(self, name: str):
        """A small value that the last batch left for the next one, None if there is none."""
        return self.pointer()["notes"].get(name)

    def commit(self, batch_id: int, **notes) -> None:
        """Make all that was written for a batch visible, with its notes; then merge parts that have become many."""
        now = self.pointer()
        now["batch"] = batch_id
        now["notes"] |= notes
        for table, part in self._parts.items():
            now["parts"].setdefault(table, []).append(part)
        for table, new in self._buckets.items():
            known = now["buckets"].setdefault(table, {"n": new["n"], "at": {}})
            now["replaced"] += [{"n": now["n"] + 1, "path": f"{table}/v={known['at'][b]}/bucket={b}"} for b in new["at"] if b in known["at"]]
            known["at"] |= new["at"]
        self._parts, self._buckets = {}, {}
        self._point(now)
        for table in list(now["parts"]):
            self._merge(table)

    # -- appended tables -----------------------------------------------------------------

    def write(self, df: DataFrame, table: str, batch_id: int, day: Column | None = None, pieces: int = 1) -> DataFrame:
        """Write a batch's part of a table, by ``day`` if given; returns it as read back, to build on without recomputing.

        A day's rows go to ``pieces`` tasks, see :func:`pieces_of`: a task that held rows of all days would write a file for each.
        """
        path, level = f"part={batch_id}-{batch_id}", 0
        rows = df.withColumn(BATCH.name, F.lit(batch_id).cast("long"))
        if day is not None:
            rows = rows.withColumn(DAY.name, day).repartition(DAY.name, F.pmod(F.xxhash64(*df.columns), F.lit(pieces)))
        self._save(rows, table, path, day is not None)
        self._parts[table] = {"path": path, "first": batch_id, "last": batch_id, "level": level, "day": day is not None}
        return self._opened(table, df.schema, [self._parts[table]]).drop(BATCH.name)

    def write_all(self, tables: dict[str, DataFrame | tuple[DataFrame, Column]], batch_id: int, pieces: int = 1) -> None:
        """Write several parts of a batch at the same time; fails if any of them does."""
        def one(item) -> None:
            name, df = item
            self.write(*((df[0], name, batch_id, df[1], pieces) if isinstance(df, tuple) else (df, name, batch_id)))

        with ThreadPoolExecutor(max(1, len(tables))) as pool:
            list(pool.map(inheritable_thread_target(self.spark)(one), tables.items()))

    def _save(self, df: DataFrame, table: str, path: str, by_day: bool) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(DAY.name) if by_day else writer).parquet(f"{self.root}/{table}/{path}")

    def _opened(self, table: str, schema: StructType, parts: list[dict], days: tuple | None = None) -> DataFrame:
        """Rows of some parts; of ``days`` (first, last) only, if given."""
        if not parts:
            return self.spark.createDataFrame([], StructType([*schema.fields, BATCH]))
        by_day = parts[0]["day"]
        full = StructType([*schema.fields, BATCH, StructField("part", StringType(), True), *([DAY] if by_day else [])])
        rows = self.spark.read.schema(full).option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/{p['path']}" for p in parts])
        if by_day and days:
            rows = rows.filter(F.col(DAY.name).between(*days))
        return rows.select(*schema.names, BATCH.name)

    def read(self, table: str, schema: StructType, days: tuple | None = None) -> DataFrame:
        """Rows of all committed batches, with their ``batch_id``."""
        return self._opened(table, schema, self.pointer()["parts"].get(table, []), days)

    def newest_part(self, table: str, schema: StructType) -> DataFrame:
        """Rows of the last part of a table that each batch writes whole."""
        parts = self.pointer()["parts"].get(table, [])
        rows = self._opened(table, schema, parts[-1:])
        return rows.filter(F.col(BATCH.name) == parts[-1]["last"]).drop(BATCH.name) if parts else rows.drop(BATCH.name)

    def _merge(self, table: str) -> None:
        """Merge the oldest ``fan`` parts of a size class into one of the next, while there are that many."""
        now, level = self.pointer(), 0
        while len(parts := [p for p in now["parts"][table] if p["level"] == level]) >= self.fan or any(p["level"] > level for p in now["parts"][table]):
            if len(parts) >= self.fan:
                old = parts[:self.fan]
                path = f"part={old[0]['first']}-{old[-1]['last']}"
                rows = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/{p['path']}" for p in old]).drop("part")
                # one file a day, more where a day is large
                self._save(rows.hint("rebalance", DAY.name) if old[0]["day"] else rows.hint("rebalance"), table, path, old[0]["day"])
                merged = {"path": path, "first": old[0]["first"], "last": old[-1]["last"], "level": level + 1, "day": old[0]["day"]}
                gone = {p["path"] for p in old}
                kept = [p for p in now["parts"][table] if p["path"] not in gone]
                now["parts"][table] = sorted([*kept, merged], key=lambda p: p["first"])
                now["replaced"] += [{"n": now["n"] + 1, "path": f"{table}/{p}"} for p in sorted(gone)]
                self._point(now)
            level += 1

    # -- keyed tables --------------------------------------------------------------------

    def buckets_of(self, table: str, default: int) -> int:
        """How many buckets a table has; what it was made with counts."""
        known = self.pointer()["buckets"].get(table)
        return known["n"] if known else default

    def touched(self, df: DataFrame, key: str, buckets: int) -> list[int]:
        """Numbers of the buckets that the keys of a batch fall into: at most ``buckets`` numbers."""
        return sorted(r[0] for r in df.select(bucket_of(key, buckets)).distinct().collect())

    def keyed(self, table: str, schema: StructType, numbers: Iterable[int] | None = None) -> DataFrame:
        """Rows of a keyed table, or of some of its buckets; opens their folders only."""
        at = self.pointer()["buckets"].get(table, {"at": {}})["at"]
        wanted = at if numbers is None else [str(n) for n in numbers if str(n) in at]
        paths = [f"{self.root}/{table}/v={at[b]}/bucket={b}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        full = StructType([*schema.fields, StructField("v", LongType(), True), StructField("bucket", IntegerType(), True)])
        return self.spark.read.schema(full).option("basePath", f"{self.root}/{table}").parquet(*paths).select(*schema.names)

    def write_keyed(self, df: DataFrame, table: str, key: str, batch_id: int, buckets: int, numbers: Iterable[int] | None = None) -> None:
        """Write whole new versions of the buckets ``numbers`` (default: those that ``df`` has rows of)."""
        path = f"{self.root}/{table}/v={batch_id}"
        marked = df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket")
        marked.write.mode("overwrite").partitionBy("bucket").parquet(path)
        if numbers is None:
            numbers = [int(n.removeprefix("bucket=")) for n in self.folder.names(f"{table}/v={batch_id}") if n.startswith("bucket=")]
        self._buckets[table] = {"n": buckets, "at": {str(n): batch_id for n in numbers}}

    def upsert(self, changes: DataFrame, table: str, schema: StructType, key: str, batch_id: int, buckets: int,
               merged: Callable[[DataFrame, DataFrame], DataFrame], numbers: list[int] | None = None) -> None:
        """Fold ``changes`` into a keyed table: ``merged(old rows, changes)`` of the buckets that the changes touch."""
        buckets = self.buckets_of(table, buckets)
        numbers = self.touched(changes, key, buckets) if numbers is None else numbers
        if numbers:
            self.write_keyed(merged(self.keyed(table, schema, numbers), changes), table, key, batch_id, buckets, numbers)


def pieces_of(batch: DataFrame) -> int:
    """In how many pieces each day of a cached batch is written: one for every ``FILE_ROWS`` of its rows."""
    return 1 + batch.count() // FILE_ROWS


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

"""SimHash near-duplicates through covering locality-sensitive hashing.

For radius r every bit position gets a random code of r+1 bits; mask v (each non-zero code) keeps the positions whose
code has an odd product with v. Whatever r positions differ, some v is orthogonal to all of their codes, so that mask
keeps none of them: each pair within the radius agrees under one of the 2^(r+1)-1 masks, with certainty.

Equal fingerprints are one node. Buckets of up to ``list_limit`` nodes are compared inside the bucket. In larger ones
no pairs are formed: for r = 3, a pair is linked exactly if some 64-bit word lies within one bit of one and two bits of the
other, so every node probes its neighbourhood words and all that meet at a word are tied to one node there. That costs a fixed number of rows
for a node, however large the bucket. Links become components by star contraction.

Defined cases: a null or blank text has fingerprint zero; null ids stand in the result, their component is the smallest
id that is not null, or null; repeated rows get the same component; an empty table gives an empty table.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, row_digest, whole_row, written
from .components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
LIST_LIMIT = 64


def masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """The covering masks, as unsigned numbers; codes are dealt evenly, then shuffled."""
    dice = random.Random(seed)
    codes = [1 + i % ((1 << (radius + 1)) - 1) for i in range(BITS)]
    dice.shuffle(codes)
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 1 << (radius + 1))]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8").translate(ASCII_LOWER).split()
    if not words:
        return 0
    pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashed = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in pieces), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(hashed), 4096):  # bounded memory for long texts
        rows = hashed[part:part + 4096].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed 64-bit number."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).astype(np.int64))

    return F.pandas_udf(run, "long")(text)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def links(nodes: DataFrame, radius: int = RADIUS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp``, with the same components as all pairs within ``radius``."""
    if radius != 3:
        raise ValueError("large buckets are resolved for radius 3 only")
    table = F.array(*[F.lit(_signed(m)) for m in masks(radius)])
    keyed = nodes.select("fp", F.posexplode(table).alias("t", "m")).select("fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(keyed.join(sizes.hint("merge"), ["t", "key"]), "simhash-buckets")
    within = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    lists = members.filter(F.col("n") <= list_limit).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    # candidates of a short list are verified where the list is; only links leave it
    near = F.filter("all", lambda v: (v < F.col("u")) & (F.bit_count(F.col("u").bitwiseXOR(v)) <= radius))
    small = lists.select("all", F.explode("all").alias("u")).select("u", F.explode(near).alias("v")).filter(within)
    crowded = members.filter(F.col("n") > list_limit).select("fp").distinct()
    one = [_signed(0), *[_signed(1 << i) for i in range(BITS)]]
    two = [_signed((1 << i) | (1 << j)) for i, j in combinations(range(BITS), 2)]
    close, far = F.array(*[F.lit(x) for x in one]), F.array(*[F.lit(x) for x in two])
    probes = crowded.select("fp", F.explode(F.transform(close, lambda d: F.struct(F.col("fp").bitwiseXOR(d).alias("word"), F.lit(True).alias("close")))).alias("p"))
    probes = probes.unionByName(crowded.select("fp", F.explode(F.transform(far, lambda d: F.struct(F.col("fp").bitwiseXOR(d).alias("word"), F.lit(False).alias("close")))).alias("p")))
    probes = probes.select("fp", "p.word", "p.close")
    # a word with a node at one bit or less ties every node that probes it to that node: at most three bits apart
    hubs = probes.groupBy("word").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1 and hub is not null")
    crowd = probes.join(hubs.hint("merge"), "word").filter("fp <> hub").select(F.greatest("fp", "hub").alias("u"), F.least("fp", "hub").alias("v"))
    return small.unionByName(crowd).distinct()


def classes(prints: DataFrame, **options) -> DataFrame:
    """(fp, root) for all fingerprints of ``prints`` that are linked to a smaller one or are such a root."""
    return components(links(prints.select("fp").distinct(), **options))


def _rooted(least: DataFrame, roots: DataFrame) -> DataFrame:
    """Fingerprints with their class's root, their own where nothing is linked. Both sides grow, so neither is sent whole."""
    return least.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, fp, component): the smallest key reachable through links."""
    prints = written(docs.select(F.col(f"`{key}`").alias("id"), fingerprints(F.col(f"`{text}`")).alias("fp")), "simhash-prints")
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = written(classes(prints, **options), "simhash-roots")
    placed = _rooted(least, roots)
    smallest = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = placed.join(smallest.hint("merge"), "root").select("fp", "component")
    return prints.join(named.hint("merge"), "fp").select(F.col("id").alias(key), "fp", "component")


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of each class of linked fingerprints: that of the smallest doc_id (ties: the smallest digest), with its columns.

    Documents are told apart by a digest of 128 bits, since with billions of rows some agree in 64.
    """
    digest = F.struct(row_digest(docs.columns).alias("a"), row_digest(docs.columns, 1).alias("b"))
    prints = written(docs.select(F.col("doc_id").alias("id"), digest.alias("digest"), fingerprints(F.col("text")).alias("fp")), "simhash-prints")
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("least"))
    roots = written(classes(prints, **options), "simhash-roots")
    first = _rooted(least, roots).groupBy("root").agg(F.min("least").alias("first")).select("first.digest")
    own = docs.select(whole_row(docs), digest.alias("digest"))
    return own.join(first.hint("merge"), "digest", "left_semi").dropDuplicates(["digest"]).select("doc.*")

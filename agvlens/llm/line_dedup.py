"""Site-relative line frequency: lines that too large a share of a site's pages contain are dropped.

Native DataFrame operations only. Lines travel as pairs of 64-bit hashes, written once; the counts combine before the
shuffle, the frequent lines are matched back over salted keys, and the text is shuffled once, by page content.

Defined cases: a null text has no lines and stays null; blank lines are neither counted nor dropped; a line that
a page repeats counts once for it but is dropped everywhere; a null site is a site of its own; equal rows count
as pages each; an empty table gives an empty table. Other columns of the input pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import group_key, written

MAX_RATIO = 0.05  # a line on more than this share of a site's pages is boilerplate
MIN_PAGES = 5  # and on so many pages at least, so that small sites lose nothing
SALTS = 32  # parts into which the occurrences of one line on one site are dealt

_OWN = ("__site", "__text", "__page", "__drop")


#: Scripts, styles and comments up to their first end, and tags. Possessive loops over what cannot be an end: no backing
#: up, no recursion, and a character is looked at once where a lazy ``.*?`` would try the end at every place.
_HIDDEN = r"<(?:(?i:script|style)\b[^<]*+(?:<(?!/(?i:script|style)>)[^<]*+)*+</(?i:script|style)>|!--[^-]*+(?:-(?!->)[^-]*+)*+-->)"
_TAG = r"<[^>]*+>"


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, worked out once however often ``then`` uses it.

    Spark finds repeated parts of plain expressions itself, but not beside or below functions with a lambda.
    """
    return F.transform(F.array(value), then)[0]


def html_lines(html: Column) -> Column:
    """The visible text of a page, each run of text between two tags on a line of its own."""
    def untagged(bare: Column) -> Column:
        # no tag begins behind the last ">", and looking for its end from each "<" there would take the square of their number
        rest = F.substring_index(bare, ">", -1)
        return F.concat(F.regexp_replace(F.left(bare, F.length(bare) - F.length(rest)), _TAG, "\n"), rest)

    return _once(F.regexp_replace(html, _HIDDEN, "\n"), untagged)


def _line_id(trimmed: Column) -> Column:
    return F.struct(F.xxhash64(trimmed).alias("a"), F.xxhash64(F.lit(1), trimmed).alias("b"))


def drop_boilerplate(pages: DataFrame, site: Column, text: Column, max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES, out: str = "text") -> DataFrame:
    """``pages`` with ``out`` (the lines kept), ``n_lines`` and ``n_dropped``; same rows, same other columns."""
    taken = {"n_lines", "n_dropped", out}
    plain = [c for c in pages.columns if c not in taken]
    # the content key stands for the page: equal texts of one site lose the same lines
    rows = pages.select(*[F.col(f"`{c}`") for c in plain], F.coalesce(site, F.lit("\u0000")).alias(_OWN[0]), text.alias(_OWN[1]))
    rows = rows.withColumn(_OWN[2], F.struct(F.xxhash64(_OWN[1]).alias("a"), F.xxhash64(F.lit(1), F.col(_OWN[1])).alias("b")))
    # told apart as texts, which takes a hash set, where structs would be compared pair by pair
    solid_lines = F.filter(F.array_distinct(F.transform(F.split(_OWN[1], "\n"), lambda s: F.trim(s))), lambda s: s != "")
    lines = F.transform(solid_lines, _line_id)
    # what the counts need of the pages, without their text: lines are cut and hashed once
    slim = written(rows.select(F.col(_OWN[0]).alias("site"), F.col(_OWN[2]).alias("page"), lines.alias("lines")), "line-ids")
    occurrences = slim.select("site", "page", F.explode("lines").alias("line"))
    totals = slim.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    frequent = (
        occurrences.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
        .join(totals, "site").filter(F.col("n") > max_ratio * F.col("total"))
        .select("site", "line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = occurrences.distinct().withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    drops = (
        salted.join(frequent, ["site", "line", "salt"], "left_semi")
        .groupBy(F.col("site").alias(_OWN[0]), F.col("page").alias(_OWN[2])).agg(F.collect_set("line").alias(_OWN[3]))
    )
    joined = rows.join(drops, [_OWN[0], _OWN[2]], "left")
    # only where a line goes are the lines cut, hashed and looked up: a column of its own, as it is used more than once
    kept = lambda lines: F.filter(lines, lambda s: ~F.array_contains(F.col(_OWN[3]), _line_id(F.trim(s))))
    pair = lambda lines: _once(kept(lines), lambda left: F.struct(F.array_join(left, "\n").alias("text"), (F.size(lines) - F.size(left)).alias("n")))
    all_lines, cut = F.split(_OWN[1], "\n"), F.col(_OWN[3])
    return joined.withColumn(_OWN[3], F.when(cut.isNotNull(), _once(all_lines, pair))).select(
        *[F.col(f"`{c}`") for c in plain],
        F.when(cut.isNull(), F.col(_OWN[1])).otherwise(cut["text"]).alias(out),
        F.when(F.col(_OWN[1]).isNull(), 0).otherwise(F.size(F.filter(all_lines, lambda s: F.trim(s) != ""))).cast("long").alias("n_lines"),
        F.when(cut.isNull(), 0).otherwise(cut["n"]).cast("long").alias("n_dropped"),  # blank lines are never among them
    )


def page_lines(pages: DataFrame, **options) -> DataFrame:
    """Boilerplate removal on ``pages`` (page_id, url, html), the host being the site."""
    from .url_rules import url_host

    lines = F.array_join(F.filter(F.transform(F.split(html_lines(F.col("html")), "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")
    slim = pages.select("page_id", url_host(F.col("url")).alias("host"), lines.alias("body"))
    return drop_boilerplate(slim, F.col("host"), F.col("body"), **options).drop("body")


def document_lines(docs: DataFrame, **options) -> DataFrame:
    """The same on ``documents``, the source being the site; returns the columns it was given, n_chars renewed."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])  # as one, so that no names clash
    slim = docs.select(others.alias("doc"), group_key("source").alias("site"), F.col("text").alias("body"))
    clean = drop_boilerplate(slim, F.col("site"), F.col("body"), **options)
    renewed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return clean.select(*[renewed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])

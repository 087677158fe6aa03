"""URL verdicts: listed host and path rules first, then mined association rules.

Pattern growth over conditional bases (FP-growth's, those of one level at once and as a table) mines combinations of URL tokens that go with
a bad label, each seen on ``min_pages`` labelled pages at least. Neither a page's tokens nor a rule's are limited in number. A combination grows only
while it may be part of a rule that holds no shorter one: it is itself no rule, it is on enough bad pages, and each of its tokens takes good pages
away, since a token that does not can be left out of any rule without loss. So tokens that always come together never have
their subsets listed. The combinations that are left grow in number with how many ways good pages mix the tokens of bad ones; where 20 bad and
more good pages mix many tokens in all ways there are exponentially many, and all are listed. Rules are matched through an inverted
index: a rule is listed under its rarest token, a URL looks up the rules under its tokens and holds their token sets against
its own. The index is a table and joins as one, so it may be of any size. Verdicts are made once per token set.

Defined cases: a null url, or one without "://", has an empty host and path and no tokens, and is allowed; repeated
pages get a row each; labels that are null or of unknown pages teach nothing; under ``min_pages`` labels no rules are mined; ties
among tokens go by frequency, then by the token; a very long url only has more tokens.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written

# The listed rules.
LISTED = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
HOT_SETS = 512


@dataclass(frozen=True)
class Mining:
    """Bounds of the mined rules: support as a share of the labelled pages and in pages, ``lift`` against the share of bad ones."""

    min_support: float = 0.002
    min_pages: int = 20
    min_confidence: float = 0.5
    min_lift: float = 1.5


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"(?s)\A([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)\A[^/?#]*(/[^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct host labels (h:), path parts (p:) and query keys (q:); numbers become one token."""
    host, path = url_host(url), url_path(url)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    tag = lambda parts, mark: F.transform(F.filter(parts, lambda s: s != ""), lambda s: F.concat(F.lit(mark), F.regexp_replace(s, "[0-9]+", "0")))
    keys = F.transform(F.split(query, "&"), lambda s: F.split_part(s, F.lit("="), F.lit(1)))
    tokens = F.concat(tag(F.split(host, r"\."), "h:"), tag(F.split(ascii_lower(path), "[/._-]+"), "p:"), tag(keys, "q:"))
    return F.when(host != "", F.array_distinct(tokens)).otherwise(F.array().cast("array<string>"))


def _baskets(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """(prefix, rest, good, bad): the sorted tokens of each labelled page among ``tokens``, behind no prefix."""
    places = pages.select("page", "bad", F.explode("tokens").alias("token")).join(tokens, "token")
    rest = places.groupBy("page", "bad").agg(F.array_sort(F.collect_list("token")).alias("rest"))
    return rest.select(F.array().cast("array<string>").alias("prefix"), "rest", (~F.col("bad")).cast("long").alias("good"), F.col("bad").cast("long").alias("bad"))


def _kept(bases: DataFrame, live: DataFrame) -> DataFrame:
    """``bases`` without the tokens that make no ``live`` combination with their prefix."""
    last = F.element_at("tokens", -1)
    ends = live.groupBy(F.slice("tokens", 1, F.size("tokens") - 1).alias("prefix")).agg(F.collect_list(last).alias("ends"))
    return bases.join(ends, "prefix").select("prefix", F.array_intersect("rest", "ends").alias("rest"), "good", "bad")


def _grown(bases: DataFrame) -> DataFrame:
    """The bases of prefixes one token longer, equal ones counted together."""
    split = bases.select("prefix", "rest", "good", "bad", F.posexplode("rest").alias("at", "token")).filter(F.col("at") + 1 < F.size("rest"))
    longer, rest = F.array_append("prefix", F.col("token")), F.slice("rest", F.col("at") + 2, F.size("rest"))
    return split.groupBy(longer.alias("prefix"), rest.alias("rest")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def _each_token_tells(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """Those of ``found`` all of whose parts with one token less are in ``shorter`` and on more good pages."""
    parts = found.select("*", F.explode(F.transform("tokens", lambda t: F.array_except("tokens", F.array(t)))).alias("part"))
    wider = parts.join(shorter.select(F.col("tokens").alias("part"), F.col("good").alias("wider")), "part").filter("wider > good")
    return wider.groupBy("tokens", "good", "bad").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.size("tokens")).drop("n")


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(tokens, confidence, support) of the rules "these tokens, then bad" from rows (tokens, bad); no rule's tokens contain another's."""
    known = labelled.filter("bad is not null and size(tokens) > 0").withColumn("page", F.monotonically_increasing_id())
    known = written(known.select("page", F.array_distinct("tokens").alias("tokens"), "bad"), "url-labelled")
    n, bad_share = known.agg(F.count(F.lit(1)), F.avg(F.col("bad").cast("double"))).first()
    least = max(mining.min_pages, math.ceil(mining.min_support * n))
    rules = labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double")
    if n < least:
        return rules
    confidence = F.col("bad") / (F.col("good") + F.col("bad"))
    sure = (confidence >= mining.min_confidence) & (confidence >= mining.min_lift * bad_share)
    single = known.select("bad", F.explode("tokens").alias("token")).groupBy(F.array("token").alias("tokens")).agg(
        F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    found, bases = written(single.filter(F.col("bad") >= least), "url-found"), None
    while True:  # ends at the longest url's number of tokens at the latest
        rules = rules.unionByName(found.filter(sure).select("tokens", confidence.alias("confidence"), (F.col("bad") / n).alias("support")))
        live = found.filter(~sure)
        bases = _baskets(known, live.select(F.col("tokens")[0].alias("token"))) if bases is None else _kept(bases, live)
        bases = written(_grown(bases), "url-bases")
        if bases.isEmpty():
            return rules
        counts = bases.select("prefix", F.explode("rest").alias("token"), "good", "bad").groupBy(F.array_append("prefix", F.col("token")).alias("tokens")).agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad")).filter(F.col("bad") >= least)
        found = written(_each_token_tells(counts, live), "url-found")


def inverted_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """Rules by their rarest token among ``urls`` (tokens)."""
    frequency = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    places = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(frequency, "token")
    return places.groupBy("tokens").agg(F.min_by(F.struct("token", "confidence", "support"), F.struct("n", "token")).alias("r")).select("r.token", F.col("tokens").alias("rule_tokens"), "r.confidence", "r.support")


def listed(host: Column, path: Column) -> Column:
    """The longest listed rule that fits, as struct(rule, verdict); null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(LISTED, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _mined_for(rows: DataFrame, sets: DataFrame, best: DataFrame) -> DataFrame:
    """``rows`` with what was mined for their token set, null if nothing.

    Sets that more than 1/HOT_SETS of the rows share, so fewer than HOT_SETS of them, come to their rows by broadcast.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    found = written(sets.join(best, "tokens", "left"), "url-found")
    large = F.col("n") > total / HOT_SETS
    marked = rows.join(F.broadcast(found.filter(large).select("tokens", F.lit(True).alias("hot"), F.col("mined").alias("at_once"))), "tokens", "left")
    rest = marked.filter("hot is null").join(found.filter(~large).select("tokens", "mined"), "tokens", "left")
    return marked.filter("hot").withColumn("mined", F.col("at_once")).unionByName(rest)


def judge(pages: DataFrame, labels: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict and the mined rule (tokens, confidence) that decided, if one did.

    ``labels`` are (doc_id, quality, toxic) of the pages' ids; bad are those of quality 0 or toxic.
    """
    url = F.col("url")
    rows = written(pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"),
                                url_tokens(url).alias("tokens")), "url-rows")
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad")).filter("page_id is not null")
    bad = bad.groupBy("page_id").agg(F.max("bad").alias("bad"))
    rules = mine(rows.join(bad.hint("merge"), "page_id").select("tokens", "bad"), mining)  # labels grow with the pages
    index = written(inverted_index(rules, rows.select("tokens")), "url-index")
    sets = written(rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")), "url-sets")  # equal token sets are matched once
    hits = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    best = hits.groupBy("tokens").agg(F.max_by(F.struct("rule_tokens", "confidence"), F.struct("confidence", "support", "rule_tokens")).alias("mined"))
    judged = _mined_for(rows, sets, best).withColumn("listed", listed(F.col("host"), F.col("path")))
    return judged.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.col("mined.rule_tokens").alias("mined_tokens"), F.col("mined.confidence").alias("mined_confidence"),
    )

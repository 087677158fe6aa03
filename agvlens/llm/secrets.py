"""Secret scanning with a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: any match must contain all trigrams of at
least one clause. Each batch of texts is a segment with an index of its own: postings of the needed trigrams over the
batch. A rule's clauses intersect postings, the clauses' results are united, and only those candidates are matched with
the expression itself. Rules without mandatory trigrams scan every text. Nothing is shuffled.

Defined cases: a null text is empty; repeated rows are scanned each; offsets are code points, ends exclusive; spans of
different kinds may overlap; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVERY = frozenset({frozenset()})  # the query that every text answers: one clause without trigrams
MOST_STRINGS, MOST_CLAUSES, MOST_CHOICES = 64, 256, 8

Query = frozenset[frozenset[bytes]]


def _absorb(clauses: set[frozenset[bytes]]) -> Query:
    """Without clauses that another one implies."""
    least = [c for c in clauses if not any(d < c for d in clauses)]
    return frozenset(least) if len(least) <= MOST_CLAUSES else EVERY


def _both(a: Query, b: Query) -> Query:
    made = _absorb({x | y for x in a for y in b}) if len(a) * len(b) <= 4096 else EVERY
    return made if made != EVERY else max(a, b, key=lambda q: min(map(len, q)))


def _trigrams(strings: set[str]) -> Query:
    """What a text that contains one of ``strings`` contains (ASCII letters folded)."""
    folded = [s.encode("utf-8").lower() for s in strings]
    return _absorb({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in folded})


def _parts(nodes, exact: set[str] | None = None) -> tuple[set[str] | None, Query]:
    """For a parsed sequence: all strings it can match (None: too many to list), and its query."""
    run, query, whole = {""}, EVERY, True
    for op, arg in nodes:
        strings, own = _part(str(op), arg)
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        query, whole = _both(_both(query, _trigrams(run)), own), False
        run = strings if strings is not None else {""}
    return (run, _trigrams(run)) if whole else (None, _both(query, _trigrams(run)))


def _part(op: str, arg) -> tuple[set[str] | None, Query]:
    if op == "LITERAL":
        return {chr(arg).lower() if arg < 128 else chr(arg)}, EVERY
    if op == "AT":
        return {""}, EVERY
    if op == "IN" and all(str(k) == "LITERAL" for k, _ in arg) and len(arg) <= MOST_CHOICES:
        return {chr(c).lower() if c < 128 else chr(c) for _, c in arg}, EVERY
    if op == "SUBPATTERN":
        return _parts(arg[-1])
    if op == "BRANCH":
        found = [_parts(p) for p in arg[1]]
        if all(s is not None for s, _ in found) and len(union := set().union(*(s for s, _ in found))) <= MOST_STRINGS:
            return union, _trigrams(union)
        return None, _absorb(set().union(*(q for _, q in found)))
    if op == "MAX_REPEAT":
        low, high, body = arg
        strings, own = _parts(body)
        if (low, int(high)) == (0, 1) and strings is not None:
            return {""} | strings, EVERY
        if strings is not None and low == int(high) and len(strings) ** low <= MOST_STRINGS:
            return {x for x in _power(strings, low)}, EVERY
        if low == 0:
            return None, EVERY
        return None, _both(own, _trigrams(_power(strings, low))) if strings is not None and len(strings) ** low <= MOST_STRINGS else own
    return None, EVERY


def _power(strings: set[str], n: int) -> set[str]:
    out = {""}
    for _ in range(n):
        out = {a + b for a in out for b in strings}
    return out


def trigram_query(pattern: str) -> Query:
    """Clauses of trigrams (over the text's UTF-8 bytes, A-Z folded), one of which every match contains whole."""
    return _parts(re._parser.parse(pattern))[1]


@dataclass(frozen=True)
class Rule:
    """``group`` (0: all) must have ``least`` characters for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    query: Query = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "query", trigram_query(self.pattern))

    @property
    def scans_all(self) -> bool:
        return frozenset() in self.query

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        return [(*m.span(), m.group()) for m in re.finditer(self.pattern, text) if len(m.group(self.group)) >= self.least]


# The rules, base kinds first.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


class Segment:
    """The trigram index of one batch of texts."""

    def __init__(self, texts: list[str], trigrams: set[bytes]):
        folded = [t.encode("utf-8").lower() for t in texts]
        self.size = len(texts)
        self.postings = {t: {i for i, data in enumerate(folded) if t in data} for t in trigrams}

    def candidates(self, query: Query) -> set[int]:
        if frozenset() in query:
            return set(range(self.size))
        return set().union(*(set.intersection(*sorted((self.postings[t] for t in clause), key=len)) for clause in query))


SEGMENT = 2048  # texts in a segment


def scan_texts(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int, str]]]:
    """(kind, start, end, value) of each text, by start, then rule."""
    segment = Segment(texts, set().union(*(c for r in rules for c in r.query)))
    found: list[list[tuple[int, int, str, int, str]]] = [[] for _ in texts]
    for order, rule in enumerate(rules):
        for i in segment.candidates(rule.query):
            found[i] += [(start, order, rule.kind, end, value) for start, end, value in rule.spans(texts[i])]
    return [[(kind, start, end, value) for start, _, kind, end, value in sorted(f)] for f in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``spans`` (kind, start, end, value) of every text."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SEGMENT):
                part = batch.iloc[at:at + SEGMENT]
                spans = scan_texts(["" if t is None else t for t in part["t"]], rules)
                yield pd.DataFrame({"k": part["k"], "spans": pd.Series(spans, index=part.index, dtype=object)})

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.selectExpr(f"`{key}` as k", f"`{text}` as t")
    return slim.mapInPandas(work, f"k {kind}, spans array<struct<kind:string,start:long,end:long,value:string>>").withColumnRenamed("k", key)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of base spans, and all spans as text."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", shown), ",").alias("spans"),
    )

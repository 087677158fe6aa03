"""The registered corpus queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, licenses, line_dedup, lm, quality, relative_lz, runs, secrets, sharding, simhash, templates, turns, url_rules
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.page_lines(table(spark, sf_dir, "pages"))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


def license_report(docs: DataFrame) -> DataFrame:
    shown = F.transform("licences", lambda s: F.concat_ws(":", s["licence"], s["n"].cast("string")))
    return licenses.scan(docs).select("doc_id", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join(shown, ",").alias("licences"), "n_unknown")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.vocabulary_path(), ("n_tokens", "ids_sha256", "decoded_sha256"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("r")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


@query
def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


@query
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(table(spark, sf_dir, "conversations"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


@query
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_lz.dedup(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES["op1_line_dedup"] = rf"""
WITH bare AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g') AS body
  FROM pages),
p AS (SELECT page_id, host, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM bare),
occ AS (SELECT page_id, host, unnest(list_distinct(lines)) AS line FROM p),
tot AS (SELECT host, count(*) AS total FROM p GROUP BY host),
often AS (SELECT host, line, count(*) AS n FROM occ GROUP BY host, line HAVING count(*) >= {line_dedup.MIN_PAGES}),
bad AS (SELECT host, list(line) AS gone FROM often JOIN tot USING (host) WHERE n > {line_dedup.MAX_RATIO} * total GROUP BY host),
cut AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(gone, x), false)) AS kept FROM p LEFT JOIN bad ON p.host = bad.host)
SELECT page_id, host, array_to_string(kept, chr(10)) AS "text", len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped FROM cut
"""


def _license_sql(documents: str = "documents") -> str:
    """The licence scan from the operator's own tables and patterns."""
    def normal(s: str) -> str:
        s = f"lower({s})"
        for pattern, by in licenses.NORMAL:
            s = f"regexp_replace({s}, '{pattern}', '{by}', 'g')"
        return f"trim({s})"

    known = ", ".join(f"('{form}', '{name}')" for form, name in licenses.KNOWN.items())
    steps, rest = [], "start"
    for i, (_, sequence) in enumerate(licenses.ALL_RULES):
        steps.append(f"s{i} AS (SELECT *, replace({rest}, ' {'  '.join(sequence)} ', ' | ') AS q{i} FROM {f's{i - 1}' if i else 'seq'})")
        rest = f"q{i}"
    bars = lambda c: f"(length({c}) - length(replace({c}, '|', '')))"
    count = {n: " + ".join(f"{bars(f'q{i}')} - {bars(f'q{i - 1}' if i else 'start')}" for i, (m, _) in enumerate(licenses.ALL_RULES) if m == n) for n in licenses.NAMES}
    shown = ", ".join(f"CASE WHEN {count[n]} > 0 THEN '{n}:' || ({count[n]}) END" for n in licenses.NAMES)
    listed = lambda of, name: f"unnest(list_transform({of}, lambda s, i: {{'s': s, 'i': i}})) AS {name}"
    parts = f"flatten(list_transform(string_split_regex(text, '{licenses.PARAGRAPHS}'), lambda x: string_split_regex(x, '{licenses.STOPS}')))"
    return rf"""
WITH known(form, name) AS (VALUES {known}),
part AS (SELECT doc_id, {listed(parts, 'p')} FROM {documents} WHERE regexp_matches(text, '{licenses.WORTH}')),
worth AS (SELECT doc_id, p.i AS i, p.s AS s FROM part WHERE regexp_matches(p.s, '{licenses.WORTH}')),
whole AS (SELECT doc_id, i, s, name FROM worth LEFT JOIN known ON form = {normal('s')}),
line AS (SELECT doc_id, i, {listed("string_split_regex(s, chr(10) || '+')", 'l')} FROM whole WHERE name IS NULL),
plain AS (SELECT doc_id, i, l.i AS j, {normal('l.s')} AS form FROM line WHERE regexp_matches(l.s, '{licenses.WORTH}')),
named AS (SELECT doc_id, i, 0 AS j, name FROM whole WHERE name IS NOT NULL
  UNION ALL SELECT doc_id, i, j, coalesce(name, CASE WHEN regexp_matches(plain.form, '{licenses.HINTS}') THEN 'unknown' END) FROM plain LEFT JOIN known ON plain.form = known.form),
listed AS (SELECT doc_id, list(name ORDER BY i, j) AS ids FROM named WHERE name IS NOT NULL GROUP BY doc_id),
seq AS (SELECT d.doc_id, coalesce(ids, []) AS ids, ' ' || array_to_string(coalesce(ids, []), '  ') || ' ' AS start FROM {documents} d LEFT JOIN listed ON d.doc_id = listed.doc_id),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ' ') AS sentence_ids, concat_ws(',', {shown}) AS licences, len(list_filter(ids, lambda x: x = 'unknown'))::BIGINT AS n_unknown FROM s{len(licenses.ALL_RULES) - 1}
"""


ORACLES["op3_license_scan"] = _license_sql()

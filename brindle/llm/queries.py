"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.embedding_dedup import embedding_groups
from brindle.llm.exact_dedup import exact_dedup
from brindle.llm.language_id import identify
from brindle.llm.mixing import mix_report
from brindle.llm.packing import pack_documents
from brindle.llm.shared import table
from brindle.llm.simhash import simhash_groups
from brindle.llm.substring_dedup import LEAST_WORDS, remove_repeats
from brindle.llm.suffix_dedup import remove_repeated_bytes
from brindle.llm.toxicity import toxicity_scores
from brindle.llm.warc import archive_round_trip


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, sf_dir, "documents"), "sentence", LEAST_WORDS)
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return cleaned.select("doc_id", "n_units", "n_removed", "removed_chars", spans.alias("removed_spans"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH pieces AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?…\n]*(?:[.!?…]+[^.!?…\n \t][^.!?…\n]*)*[.!?…]*(?:[ \t]+|\n|$)') AS parts FROM documents),
units AS (
  SELECT doc_id, unnest(parts) AS unit, unnest(range(1, len(parts) + 1)) AS k FROM pieces),
placed AS (
  SELECT doc_id, k, unit, sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY k) - length(unit) AS s,
    lower(trim(regexp_replace(unit, '[ \t\r\n\x0B\x0C]+', ' ', 'g'), ' ')) AS norm FROM units WHERE unit <> ''),
ranked AS (
  SELECT *, norm <> '' AS solid, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, k) > 1 AS again,
    CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS words FROM placed),
runs AS (
  SELECT *, count(*) FILTER (solid AND NOT again) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM ranked),
marked AS (
  SELECT *, again AND sum(words) FILTER (again) OVER (PARTITION BY doc_id, run) >= {LEAST_WORDS} AS gone FROM runs)
SELECT documents.doc_id, count(*) FILTER (solid)::BIGINT AS n_units, count(*) FILTER (gone)::BIGINT AS n_removed,
  coalesce(sum(length(unit)) FILTER (gone), 0)::BIGINT AS removed_chars,
  coalesce(string_agg(s::BIGINT || '-' || (s + length(unit))::BIGINT, ',' ORDER BY k) FILTER (gone), '') AS removed_spans,
  sha256(coalesce(string_agg(CASE WHEN gone THEN '' ELSE unit END, '' ORDER BY k), '')) AS kept_sha256
FROM documents LEFT JOIN marked USING (doc_id) GROUP BY documents.doc_id
"""

OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT body, max(page_id) AS first FROM p GROUP BY body)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (body)
"""

OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, text_sha256 FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_suffix_dedup, op4_warc, op5_embedding_dedup, op6_simhash, op7_toxicity, op8_exact_dedup, op9_mixing, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op4_warc": OP4_SQL, "op8_exact_dedup": OP8_SQL}

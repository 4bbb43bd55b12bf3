"""Query of the quality rules and its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookpulse.llm import quality
from bookpulse.llm.common import table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base verdict and the current policy's verdict for each document."""
    measured = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.BASE)) != 0
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each rule of the current policy: documents that it rejects, and that only it rejects."""
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents").select("text")))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win FROM w, unnest(range(1, len(ws) - 1)) AS u(i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
), f AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END | CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    | CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END | CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
    | CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END | CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""

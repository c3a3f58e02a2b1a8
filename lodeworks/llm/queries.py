"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compressor, credentials, cube, decontaminate, linededup, multiindex, passages, sanitise, simhash, warc
from .common import table


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.recurring(spark, table(spark, sf_dir, "documents"))


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.bundles(table(spark, sf_dir, "pages"))


def op3_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.linked(spark, table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.mix_sources(spark, table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressor.classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a stated set of queries, against all vectors
    return multiindex.neighbours(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_lines(spark, table(spark, sf_dir, "documents"))


def op10_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.sanitise(spark, table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_passages, op2_warc_bundles, op3_credentials, op4_mix_sources, op5_quality, op6_decontaminate, op7_neighbours, op8_near_duplicates, op9_line_dedup, op10_sanitise)}

_LINES = f"""
lines AS (
  SELECT doc_id, i - 1 AS line_no, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) d,
       LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) r
  WHERE regexp_matches(parts[i], '{linededup.SOLID}')
)"""

ORACLE_SQL = {
    # every deletion variant of every line by characters and by words, without the blocking of the Spark plan
    "op9_line_dedup": f"""
WITH {_LINES},
firsts AS (SELECT line, min(doc_id * 1000000 + line_no) AS own, length(line) AS n, string_split(line, ' ') AS words FROM lines GROUP BY line),
variants AS (
  SELECT line, own, p, substr(line, 1, p - 1) || substr(line, p + 1) AS v, 'c' AS unit
  FROM (SELECT line, own, unnest(range(1, n + 1)) AS p FROM firsts WHERE n >= {linededup.MIN_FUZZY}) f
  UNION ALL
  SELECT line, own, p, array_to_string(list_concat(words[:p - 1], words[p + 1:]), ' '), 'w'
  FROM (SELECT line, own, words, unnest(range(1, len(words) + 1)) AS p FROM firsts WHERE len(words) >= {linededup.MIN_WORDS}) f
),
wholes AS (
  SELECT line, own, 'c' AS unit FROM firsts WHERE n >= {linededup.MIN_FUZZY}
  UNION ALL
  SELECT line, own, 'w' FROM firsts WHERE len(words) >= {linededup.MIN_WORDS}
),
pairs AS (
  SELECT a.line, min(b.own) AS near FROM variants a JOIN variants b ON a.v = b.v AND a.p = b.p AND a.unit = b.unit AND b.own < a.own GROUP BY a.line
  UNION ALL
  SELECT a.line, min(b.own) FROM variants a JOIN wholes b ON a.v = b.line AND a.unit = b.unit AND b.own < a.own GROUP BY a.line
  UNION ALL
  SELECT b.line, min(a.own) FROM variants a JOIN wholes b ON a.v = b.line AND a.unit = b.unit AND a.own < b.own GROUP BY b.line
),
best AS (SELECT line, min(near) AS near FROM pairs GROUP BY line)
SELECT l.doc_id, CAST(l.line_no AS INTEGER) AS line_no,
       CAST(least(coalesce(near, own), own) // 1000000 AS BIGINT) AS first_doc_id, CAST(least(coalesce(near, own), own) % 1000000 AS INTEGER) AS first_line_no,
       CAST(CASE WHEN near IS NULL THEN 0 ELSE 1 END AS INTEGER) AS edits
FROM (SELECT DISTINCT doc_id, line_no, line FROM lines) l JOIN firsts USING (line) LEFT JOIN best USING (line)
WHERE coalesce(near, own) < l.doc_id * 1000000 + l.line_no
"""
}

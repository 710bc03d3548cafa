"""Registered queries and the SQL that gives the same rows.

Each module holds QUERIES (name -> f(spark, sf_dir)) and SQL (name -> DuckDB SQL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: DuckDB forms of the shared pieces. NORM: key of a line; LINES: documents by line.
NORM = r"trim(regexp_replace(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), '^[#•|\s]+', ''))"
BARE = r"regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '^[ #•|]+|[ #•|]+$', '', 'g')"
LABEL = "(" + BARE + r" = '' OR (length(" + BARE + r") <= 40 AND NOT regexp_matches(" + BARE + r", '(?i)\d|@|\b\w+\.(?:edu|com|org|net|pk)\b')))"
LINES = f"""lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
keyed AS (SELECT *, {NORM.format('line')} AS key FROM lines),
freq AS (SELECT key, count(DISTINCT doc_id) AS df FROM keyed WHERE key <> '' GROUP BY key),
total AS (SELECT count(*) AS n FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

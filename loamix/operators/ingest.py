"""Incremental ingest: what changed between two snapshots, and the table after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamix.functions import text as T


def with_page_hash(pages: DataFrame, text: str = "text") -> DataFrame:
    """page_hash leaves image blocks out; legacy_hash takes the whole text."""
    return pages.withColumn("page_hash", T.content_hash(T.strip_image_blocks(F.col(text)))).withColumn("legacy_hash", T.content_hash(F.col(text)))


def statuses(stored: DataFrame, arrived: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """key, status: empty, skipped, updated or added. stored: (key, page_hash), of which some may be legacy hashes."""
    new = with_page_hash(arrived, text).select(key, (F.trim(text) == "").alias("empty"), "page_hash", "legacy_hash")
    old = stored.groupBy(key).agg(F.collect_set("page_hash").alias("hashes"))
    same = F.array_contains("hashes", F.col("page_hash")) | F.array_contains("hashes", F.col("legacy_hash"))
    status = F.when(F.coalesce(F.col("empty"), F.lit(True)), "empty").when(F.col("hashes").isNull(), "added").when(same, "skipped").otherwise("updated")
    return new.join(old, key, "left").select(key, status.alias("status"))


def upserted(stored: DataFrame, arrived: DataFrame, key: str = "source", text: str = "text") -> DataFrame:
    """The table after the ingest: rows of updated keys give way to the new ones; everything else stays."""
    verdict = statuses(stored, arrived, key, text)
    fresh = verdict.filter(F.col("status").isin("added", "updated")).select(key)
    kept = stored.join(fresh, key, "left_anti")
    new = with_page_hash(arrived, text).join(fresh, key, "left_semi").select(*stored.columns)
    return kept.unionByName(new)


def status_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("status").agg(F.count("*").alias("n"))

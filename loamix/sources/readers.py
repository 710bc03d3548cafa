"""Readers of lists, files and sitemaps, and report writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamix.functions import urls as U


def url_list(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV list with a header; a byte-order mark and outer spaces go, a missing column is an error."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    missing = [c for c in columns if c not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    clean = raw.toDF(*names)
    return clean.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in columns])


def checked_list(rows: DataFrame, categories: list[str]) -> DataFrame:
    """address, problem: rows with a bad category or keep mark, and copies by path after the first."""
    from pyspark.sql import Window

    at = rows.withColumn("at", F.monotonically_increasing_id()).withColumn("p", U.path(F.col("address")))
    first = F.row_number().over(Window.partitionBy("p").orderBy("at"))
    problem = (
        F.when(F.col("address") == "", "no address")
        .when(~F.col("category").isin(categories), "unknown category")
        .when(~F.col("keep").isin("yes", "no"), "keep is neither yes nor no")
        .when(F.col("first") > 1, "listed before")
    )
    return at.withColumn("first", first).select("address", problem.alias("problem")).filter("problem is not null")


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """source, text: whole files under a folder."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    return files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", known: DataFrame | None = None) -> DataFrame:
    """source, content, doc_hash of files whose hash isn't known yet."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    rows = files.select(F.col("path").alias("source"), "content", F.md5("content").alias("doc_hash"))
    return rows if known is None else rows.join(known.select("doc_hash"), "doc_hash", "left_anti")


def category_of_file(name, rules: list[tuple[str, str]], fallback: str = "general"):
    """First rule whose keyword is in the file's name."""
    out = F.lit(fallback)
    for word, category in reversed(rules):
        out = F.when(F.contains(F.lower(name), F.lit(word)), category).otherwise(out)
    return out


def sitemap_urls(xml: DataFrame, column: str = "xml") -> DataFrame:
    """Addresses of a sitemap or a sitemap index."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    kind = F.when(F.contains(F.col(column), F.lit("<sitemapindex")), "index").otherwise("page")
    return xml.select(F.explode(F.array_distinct(found)).alias("address"), kind.alias("kind"))


def write_report(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """A bounded report as one Markdown text."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r"))))
    return df.agg(F.concat_ws("\n", F.lit(head), F.array_join(F.transform(lines, lambda x: x["r"]), "\n")).alias("markdown"))

"""Comparisons and counts behind reports, and parsing of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamix.functions import text as T


def tagged_reply(reply: Column) -> Column:
    """intent and answer of a reply: a JSON object, with or without a fence, or INTENT: and ANSWER: lines."""
    bare = F.trim(F.regexp_replace(reply, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    is_json = bare.startswith("{")
    intent = F.when(is_json, F.get_json_object(bare, "$.intent")).otherwise(F.trim(F.regexp_extract(reply, r"INTENT:\s*(\w+)", 1)))
    answer = F.when(is_json, F.get_json_object(bare, "$.answer")).otherwise(F.trim(F.regexp_extract(reply, r"(?s)ANSWER:\s*(.*)$", 1)))
    return F.struct(intent.alias("intent"), answer.alias("answer"))


def extractor_loss(old: DataFrame, new: DataFrame, page: str) -> DataFrame:
    """page, n_old, n_lost: lines of fifteen characters or more that the new extractor no longer gives."""
    keyed = lambda df: df.select(page, T.normalised(F.col("line")).alias("key")).filter("key <> ''").distinct()
    a, b = keyed(old).filter("length(key) >= 15"), keyed(new)
    lost = a.join(b, [page, "key"], "left_anti").groupBy(page).agg(F.count("*").alias("n_lost"))
    return a.groupBy(page).agg(F.count("*").alias("n_old")).join(lost, page, "left").select(page, "n_old", F.coalesce("n_lost", F.lit(0)).cast("bigint").alias("n_lost"))


def smallest_gap(requests: DataFrame, by: str, ts: str, order: str) -> DataFrame:
    """by, n, gap_ms: the least time between requests that follow one another."""
    w = Window.partitionBy(by).orderBy(ts, order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gaps = requests.withColumn("gap", at - F.lag(at).over(w))
    return gaps.groupBy(by).agg(F.count("*").alias("n"), F.floor(F.min("gap") / 1000).alias("gap_ms"))


def stable_runs(readings: DataFrame, by: str, order: str, value: Column, least: int = 3) -> DataFrame:
    """by, first_at: the first reading from which the value stayed equal `least` times."""
    w = Window.partitionBy(by).orderBy(order)
    rows = readings.select(by, order, value.alias("v"))
    change = F.coalesce((F.col("v") != F.lag("v").over(w)).cast("int"), F.lit(0))
    runs = rows.withColumn("c", change).withColumn("run", F.sum("c").over(w))
    sized = runs.groupBy(by, "run").agg(F.count("*").alias("n"), F.min(order).alias("first_at"))
    return sized.filter(F.col("n") >= least).groupBy(by).agg(F.min("first_at").alias("first_at"))


def community_inputs(edges: DataFrame, members: DataFrame, most: int = 20) -> DataFrame:
    """community, n_lines, lines: relations inside each community, as the summary's input."""
    home = lambda side: members.select(F.col("node").alias(side), F.col("community").alias(f"c_{side}"))
    inside = edges.join(home("src"), "src").join(home("dst"), "dst").filter("c_src = c_dst")
    rank = F.row_number().over(Window.partitionBy("c_src").orderBy("src", "dst"))
    rows = inside.withColumn("rank", rank).filter(F.col("rank") <= most)
    line = F.concat(F.col("src"), F.lit(" "), F.col("relation"), F.lit(" "), F.col("dst"))
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return rows.groupBy(F.col("c_src").alias("community")).agg(F.count("*").alias("n_lines"), F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("lines"))


def by_intent(scored: DataFrame, budget: int = 8, floor: float = -7.0) -> DataFrame:
    """Rows (query_id, intent_no, chunk_id, score) of several intents in turn, within one budget; a chunk appears once."""
    intents = F.size(F.collect_set("intent_no").over(Window.partitionBy("query_id")))
    place = F.row_number().over(Window.partitionBy("query_id", "intent_no").orderBy(F.col("score").desc(), "chunk_id"))
    rows = scored.filter(F.col("score") >= floor).withColumn("n", intents).withColumn("place", place)
    rows = rows.filter(F.col("place") <= F.greatest(F.lit(2), F.floor(F.lit(budget) / F.col("n"))))
    once = rows.withColumn("copy", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("place", "intent_no"))).filter("copy = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("place", "intent_no"))
    return once.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= budget).select("query_id", "intent_no", "chunk_id", "rank")


def ordered_unscored(rows: DataFrame, is_person_query: Column, is_directory: Column, penalty: Column, bonus: float = 4.0) -> DataFrame:
    """All rows (query_id, chunk_id, score) in order of score less penalty; a directory gains on questions for people."""
    value = F.col("score") - penalty + F.when(is_person_query & is_directory, bonus).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("value", 6).desc(), "chunk_id"))
    return rows.withColumn("value", value).withColumn("rank", rank.cast("bigint")).select("query_id", "chunk_id", "rank")

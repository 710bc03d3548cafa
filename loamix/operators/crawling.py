"""Verdicts on crawled pages and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamix.functions import text as T
from loamix.functions import urls as U

LEAST_TEXT = 200
FILLER = ("the", "of", "and", "for", "page", "html", "pdf", "new", "index")


def page_verdicts(pages: DataFrame, home_text: str, not_found: list[str]) -> DataFrame:
    """requested, result, duplicate_of for (requested, final, text, has_login, at): login, not-found message, moved, twin, thin, real."""
    flat = T.folded(F.col("text"))
    keys = F.transform(F.split("text", "\n"), T.normalised)
    missing = F.lit(bool(not_found)) & F.forall(F.array(*[F.lit(x) for x in not_found]), lambda x: F.array_contains(keys, x)) if not_found else F.lit(False)
    rows = pages.withColumn("flat", flat).withColumn("want", U.normalised(F.col("requested"))).withColumn("got", U.normalised(F.col("final")))
    rows = rows.withColumn("missing", missing).withColumn("text_key", F.sha1(F.col("flat").cast("binary")))
    home = U.path(F.col("requested")) == "/"
    firsts = rows.groupBy("text_key").agg(F.min_by("want", "at").alias("twin"))  # the first page of a text, however many have it
    rows = rows.join(firsts, "text_key", "left")
    same_as_home = ~home & (F.lit(home_text) != "") & (F.col("flat") == F.lit(" ".join(home_text.split())))
    result = (
        F.when(F.col("has_login"), "SKIPPED")
        .when(F.col("missing"), "NOT_FOUND")
        .when((F.col("got") != F.col("want")) | same_as_home | (F.col("twin") != F.col("want")), "DUPLICATE")
        .when(F.length("flat") < LEAST_TEXT, "THIN")
        .otherwise("REAL")
    )
    of = F.when(result == "DUPLICATE", F.when(F.col("got") != F.col("want"), F.col("final")).when(same_as_home, F.lit("home")).otherwise(F.col("twin")))
    return rows.select("requested", result.alias("result"), of.alias("duplicate_of"))


def link_verdict(link: Column, final: Column, status: Column, content_type: Column, kind: Column, length: Column) -> Column:
    moved = U.normalised(final) != U.normalised(link)
    right = F.when(kind == "pdf", F.contains(content_type, F.lit("pdf"))).when(kind == "image", content_type.startswith("image/")).otherwise(F.lit(True))
    return (
        F.when((kind != "page") & ((status >= 400) | ~right), "DEAD")
        .when(kind != "page", F.when(moved, "REDIRECTED").otherwise("WORKING"))
        .when((U.path(link) != "/") & (U.path(final) == "/"), "REVIEW")
        .when(status >= 400, F.when(length < LEAST_TEXT, "DEAD").when(moved, "REDIRECTED").otherwise("REVIEW"))
        .when(length < LEAST_TEXT, "REVIEW")
        .when(moved, "REDIRECTED")
        .otherwise("WORKING")
    )


def topic_words(url: Column) -> Column:
    last = F.try_element_at(U.segments(U.path(url)), F.lit(-1))
    return F.array_distinct(F.filter(F.split(F.coalesce(last, F.lit("")), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*FILLER)))


def old_to_new(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """old, new, overlap: the best new address by shared topic words.

    Words are ordered from rare to frequent among the new addresses. Two sets
    alike enough share one of the first n - ceil(least * n) + 1 words of each,
    so a common word joins only addresses that have hardly another.
    """
    a = old.select(F.col("old").alias("url"), topic_words(F.col("old")).alias("words")).distinct()
    b = new.select(F.col("new").alias("url"), topic_words(F.col("new")).alias("words")).distinct()
    rare = b.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))

    def firsts(side: DataFrame) -> DataFrame:
        spread = side.select("url", "words", F.explode("words").alias("w")).join(rare, "w", "left")
        order = F.row_number().over(Window.partitionBy("url").orderBy(F.coalesce("df", F.lit(0)), "w"))
        n = F.size("words")
        return spread.withColumn("r", order).filter(F.col("r") <= n - F.ceil(n * least) + 1).select("url", "words", "w")

    near = firsts(a).select(F.col("url").alias("old"), F.col("words").alias("wa"), "w").join(firsts(b).select(F.col("url").alias("new"), F.col("words").alias("wb"), "w"), "w")
    near = near.select("old", "new", "wa", "wb").distinct()
    overlap = F.round(F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb")), 6)
    scored = near.select("old", "new", overlap.alias("overlap")).filter(F.col("overlap") >= least)
    best = scored.groupBy("old").agg(F.min(F.struct((-F.col("overlap")).alias("o"), F.length("new").alias("l"), F.col("new").alias("new"))).alias("b"))
    return old.select("old").join(best, "old", "left").select("old", F.col("b.new").alias("new"), (-F.col("b.o")).alias("overlap"))

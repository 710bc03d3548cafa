"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamix.llm.common import drop_stored, stored


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.join(least, "a").filter(F.col("b") > F.col("a"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return tied.unionByName(own).filter("a <> b").distinct()


def stars(edges: DataFrame, most_rounds: int = 60) -> tuple[DataFrame, str]:
    """(a, b) with b the least node of a's component, for each node a but the least; and its scratch path.

    Every round is written to the shared folder. Rounds end when the edges no
    longer change, told by their number and the sums of two hashes.
    """
    spark = edges.sparkSession
    current, path = stored(edges.filter("a <> b").select("a", "b"), "edges")

    def state(df: DataFrame):
        h, g = F.xxhash64("a", "b"), F.hash("b", "a").cast("decimal(38,0)")
        return df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(g)).first()

    seen = state(current)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        after, to = stored(small_star(large_star(current)), "edges")
        drop_stored(spark, path)
        current, path = after, to
        now = state(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return current, path

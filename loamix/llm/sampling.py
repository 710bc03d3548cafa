"""Bounded samples of labelled rows for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamix.llm.common import drop_stored, stored


def sample(labelled: DataFrame, docs: DataFrame, per_label: int, longest: int) -> list[tuple[str, object]]:
    """(text, label) of at most per_label documents of each label, in a fixed order.

    labelled: (doc_id, label). Candidates are documents with a text of 1 to
    `longest` characters; the ids of the least hashes are chosen among them
    without moving texts, then one text of each chosen id is read (the least, if
    rows share an id). So the driver holds per_label texts of `longest`
    characters a label at most, and the ids that are broadcast are as few.
    """
    spark = docs.sparkSession
    fits = docs.filter(F.col("doc_id").isNotNull() & F.length("text").between(1, longest))
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(1 << 40))
    ids = labelled.filter(F.col("label").isNotNull()).select("doc_id", "label").join(fits.select("doc_id"), "doc_id", "left_semi")
    # one label for an id that has several: the least
    ids = ids.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("u", unit)
    ids, ids_path = stored(ids, "labelled-ids")
    counts = ids.groupBy("label").agg(F.count("*").alias("n"))  # one row a label
    # a threshold leaves a little more than per_label rows of each label to be ranked, however many there are
    under = F.floor(F.lit(1 << 40) * F.least(F.lit(1.0), (1.2 * per_label + 50) / F.col("n"))).alias("under")
    few = ids.join(F.broadcast(counts.select("label", under)), "label").filter(F.col("u") <= F.col("under"))
    order = Window.partitionBy("label").orderBy("u", "doc_id")
    chosen = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_label).select("doc_id", "label", "u")
    kept, path = stored(chosen, "sample-ids")
    drop_stored(spark, ids_path)
    texts = fits.select("doc_id", "text").join(F.broadcast(kept), "doc_id").groupBy("doc_id", "label", "u").agg(F.min("text").alias("text"))
    rows = texts.collect()
    drop_stored(spark, path)
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (str(r["label"]), r["u"], r["doc_id"]))]

"""Streams of pages, events and messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loamix.operators import ingest
from loamix.sources import scratch


def upsert_stream(pages: DataFrame, base: str, key: str = "source", text: str = "text") -> DataStreamWriter:
    """Each batch of pages is judged against the newest version of the table at `base`, and a new version is written.

    A batch that is run again after a failure finds its pages unchanged and so
    writes the same table.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(key).agg(F.max(text).alias(text))  # one page of a key in a batch
        known = scratch.versions(spark, base)
        empty = spark.createDataFrame([], f"{key} string, page_hash string")
        stored = scratch.load_version(spark, base) if known else empty
        scratch.save_version(ingest.upserted(stored, last, key, text), base)

    return pages.writeStream.foreachBatch(apply).outputMode("append")


def session_windows(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, started, ended, n of sessions that no late event can reach any more."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def event_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", size: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("started"), kind, "n", "total")


def fresh_pages(pages: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first of pages with equal contents within the watermark."""
    return pages.withWatermark(ts, late).dropDuplicatesWithinWatermark(["content_hash"])


def recent_messages(turns: DataFrame, keep: int = 20, idle_ms: int | None = 86_400_000) -> DataFrame:
    """conv_id, n_seen, recent: after each batch, the last messages of the conversations in it; ones idle for idle_ms are forgotten (None: none is)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, recent = state.get if state.exists else (0, "")
        held = recent.split("\x1e") if recent else []
        for batch in batches:
            batch = batch.sort_values("turn")
            held = (held + [f"{r}: {t}" for r, t in zip(batch["role"], batch["text"])])[-keep:]
            seen += len(batch)
        state.update((seen, "\x1e".join(held)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "n_seen": [seen], "recent": ["\n".join(held)]})

    return turns.groupBy("conv_id").applyInPandasWithState(
        step, "conv_id long, n_seen long, recent string", "seen long, recent string", "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    )

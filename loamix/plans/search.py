"""The whole search: candidates, fusion, re-ranking, parents and the gate, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamix.operators import retrieval as R
from loamix.operators import scorers

CANDIDATES = 50


def search(chunks: DataFrame, queries: DataFrame, pair_score: Column | None = None, top: int = R.TOP) -> DataFrame:
    """query_id, chunk_id, score, pos for (chunk_id, text, source, department, embedding) and (query_id, text, embedding).

    Keyword and vector candidates are fused by rank, scored in pairs with the
    question, made diverse and gated.
    """
    words = R.bm25(chunks, queries, CANDIDATES, "chunk_id").select("query_id", F.lit(0).alias("list_no"), "rank", "chunk_id")
    asked = queries.select("query_id", F.col("embedding").alias("q"))
    near = R.dense(chunks.select("chunk_id", "embedding"), asked, CANDIDATES, "chunk_id").select("query_id", F.lit(1).alias("list_no"), "rank", "chunk_id")
    fused = R.rrf(words.unionByName(near), "chunk_id", CANDIDATES).select("query_id", "chunk_id")
    rows = fused.join(chunks.select("chunk_id", "text", "source", "department"), "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    scorer = pair_score if pair_score is not None else scorers.column(scorers.pair_score, "double")(F.col("query"), F.col("text"))
    wanted = F.contains(F.lower("query"), F.lower("department"))
    scored = rows.select("query_id", "chunk_id", "source", "department", F.md5(F.col("text").cast("binary")).alias("content_key"), scorer.alias("score"), wanted.alias("wanted"))
    return R.score_gate(R.diverse(scored, top).select("query_id", "chunk_id", "score"))

"""Keyword and vector search, fusion, re-ranking, gating and parent expansion."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamix.functions import text as T
from loamix.sources.scratch import load_version, save_version

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF = 60
FLOOR, LEAST_KEPT, CLIFF, MOST_KEPT = -7.0, 3, 2.0, 8
A_SOURCE, MARGIN, TOP = 2, 2.0, 10
#: Rows of a batch of queries that are sent to every task.
MOST_SENT = 100_000
#: Vectors in a block of queries and of chunks: about 2 and 4 MB at 1,024 dimensions.
QUERY_BLOCK, CHUNK_BLOCK = 256, 512
#: Fixed value: facts that a child may add to its parent.
DETAIL = r"(?i)[\w.+-]+@[\w-]+\.[\w.]+|\+?\d[\d\s()-]{7,}\d|\d+(?:\.\d+)?\s*%|\brs\.?\s*\d"


def terms(text: Column) -> Column:
    return F.split(F.trim(F.lower(text)), r"\s+")


@dataclass(frozen=True)
class Index:
    """An inverted index: postings (term, key, tf, dl, further columns), terms (term, df, idf) and one row of sizes (n, avgdl)."""

    postings: DataFrame
    words: DataFrame
    sizes: DataFrame
    key: str = "doc_id"

    def save(self, base: str) -> Index:
        """Written as new versions of three tables and read again; postings lie sorted by term."""
        postings = self.postings.repartitionByRange("term", self.key).sortWithinPartitions("term", self.key)
        for name, df in (("postings", postings), ("words", self.words), ("sizes", self.sizes)):
            save_version(df, f"{base}/{name}")
        return load_index(self.sizes.sparkSession, base, self.key)


def load_index(spark: SparkSession, base: str, key: str = "doc_id") -> Index:
    """The newest complete version of a stored index."""
    return Index(*[load_version(spark, f"{base}/{name}") for name in ("postings", "words", "sizes")], key)


def index_of(chunks: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> Index:
    """The index of chunks; columns in `carry` (a category, say) go into each posting.

    A negative weight of a term is replaced by a share of the mean weight.
    """
    told = chunks.select(key, *carry, terms(F.col(text)).alias("terms")).withColumn("dl", F.size("terms"))
    postings = told.select(key, *carry, "dl", F.explode("terms").alias("term")).groupBy("term", key, "dl", *carry).agg(F.count("*").alias("tf"))
    sizes = told.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    weighted = df.crossJoin(F.broadcast(sizes.select("n"))).withColumn("raw", raw)
    mean = weighted.agg(F.avg("raw").alias("mean_raw"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_raw")).otherwise(F.col("raw"))
    return Index(postings, weighted.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf")), sizes, key)


def bm25_search(index: Index, queries: DataFrame, top: int = TOP, within: Column | None = None) -> DataFrame:
    """query_id, key, score, rank: best chunks for each query by BM25 with a floor for negative weights.

    Each term of a query counts as often as it is used; only positive scores
    count, ties fall to the smaller key. `within` is a condition on the columns
    that the index carries. The queries' weights are sent to the postings while
    they are few; beyond that the join is Spark's, which may split a common term.
    """
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    weights = index.words.join(few(asked), "term").crossJoin(F.broadcast(index.sizes)).select("query_id", "term", "qtf", "avgdl", "idf")
    found = index.postings if within is None else index.postings.filter(within)
    gain = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = found.join(few(weights), "term").groupBy("query_id", index.key).agg(F.round(F.sum(gain), 6).alias("score")).filter("score > 0")
    return ranked(scored, [F.col("score").desc(), F.col(index.key)], top)


def few(rows: DataFrame) -> DataFrame:
    """rows to be sent to every task, if they are at most MOST_SENT."""
    return F.broadcast(rows) if rows.limit(MOST_SENT + 1).count() <= MOST_SENT else rows


def bm25(chunks: DataFrame, queries: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`bm25_search` over an index that isn't kept."""
    return bm25_search(index_of(chunks, key, text), queries, top)


def ranked(scored: DataFrame, order: list[Column], top: int, by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or ["query_id"])).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= top)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of length zero or of different sizes."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def unit_blocks(vectors: DataFrame, key: str, vector: str, size: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of at most `size` unit vectors of one length: keys, dim, matrix (doubles, row by row) and carried columns as arrays."""
    fields = vectors.schema
    types = ", ".join(f"{c}s array<{fields[c].dataType.simpleString()}>" for c in (key, *carry))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                column = part.column(vector)
                lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
                for dim in sorted(set(lengths.tolist()) - {0}):
                    own = part.filter(pa.array(lengths == dim))
                    x = own.column(vector).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
                    norm = np.sqrt((x * x).sum(axis=1))
                    solid = norm > 0  # also false for a vector with a null in it
                    if solid.any():
                        own = own.filter(pa.array(solid))
                        values = [pa.array([own.column(c).to_pylist()]) for c in (key, *carry)]
                        matrix = (x[solid] / norm[solid, None]).tobytes()
                        yield pa.RecordBatch.from_arrays([*values, pa.array([dim], pa.int32()), pa.array([matrix], pa.binary())], [*[f"{c}s" for c in (key, *carry)], "dim", "matrix"])

    return vectors.select(key, *carry, vector).mapInArrow(run, f"{types}, dim int, matrix binary")


def dense(chunks: DataFrame, queries: DataFrame, top: int = TOP, key: str = "vec_id", vector: str = "embedding", least: float | None = None, itself: bool = False) -> DataFrame:
    """query_id, key, score, rank by cosine of (query_id, q) against all chunks, block by block.

    Vectors are made of length one once; a block of queries meets a block of
    chunks in one matrix product, of which the best `top` of each query are kept
    (all that are equal to the last of them, as ties fall to the smaller key).
    Null and zero vectors, and those of another length, are not found.
    """
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {chunks.schema[key].dataType.simpleString()}, score double"
    asked = unit_blocks(queries.select("query_id", F.col("q").alias("vector")), "query_id", "vector", QUERY_BLOCK).withColumnRenamed("matrix", "asked")
    held = unit_blocks(chunks, key, vector, CHUNK_BLOCK)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column("dim")[row].as_py()
                q = np.frombuffer(batch.column("asked")[row].as_py()).reshape(-1, dim)
                c = np.frombuffer(batch.column("matrix")[row].as_py()).reshape(-1, dim)
                query_ids, keys = batch.column("query_ids")[row].values, batch.column(f"{key}s")[row].values
                score = np.round(q @ c.T, 6) + 0.0
                if not itself:
                    same = np.asarray(query_ids.to_pylist(), dtype=object)[:, None] == np.asarray(keys.to_pylist(), dtype=object)[None, :]
                    score[same] = -2
                if score.shape[1] > top:
                    last = np.partition(score, -top, axis=1)[:, -top][:, None]
                    at = np.nonzero((score >= last) & (score > -2))
                else:
                    at = np.nonzero(score > -2)
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(at[0])), keys.take(pa.array(at[1])), pa.array(score[at])], ["query_id", key, "score"])

    pairs = held.join(asked, "dim").select("query_ids", f"{key}s", "dim", "asked", "matrix").mapInArrow(run, kinds)
    if least is not None:
        pairs = pairs.filter(F.col("score") >= least)
    return ranked(pairs, [F.col("score").desc(), F.col(key)], top)


def rrf(lists: DataFrame, key: str, top: int) -> DataFrame:
    """Fusion of ranked lists (query_id, list_no, rank from 1, key): sum of 1 / (60 + rank from 0)."""
    fused = lists.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (RRF + F.col("rank") - 1)), 9).alias("score"))
    return ranked(fused, [F.col("score").desc(), F.col(key)], top)


def interleaved(lists: DataFrame, key: str, top: int) -> DataFrame:
    """Round robin over lists (query_id, list_no, rank, key), first of equal keys wins."""
    first = Window.partitionBy("query_id", key).orderBy("rank", "list_no")
    once = lists.withColumn("seen", F.row_number().over(first)).filter("seen = 1").drop("seen")
    return ranked(once.withColumnRenamed("rank", "list_rank"), [F.col("list_rank"), F.col("list_no")], top)


def quota_by(rows: DataFrame, category: str, key: str, quota: int, top: int) -> DataFrame:
    """query_id, key, category, rank: the best `quota` of each category by turns over the categories, in their order."""
    best = ranked(rows, [F.col("score").desc(), F.col(key)], quota, ["query_id", category])
    out = interleaved(best.select("query_id", F.col(category).alias("list_no"), "rank", key), key, top)
    return out.select("query_id", key, F.col("list_no").alias(category), "rank")


def cache_lookup(cache: DataFrame, queries: DataFrame, now: Column, least: float = 0.90, hours: int = 24) -> DataFrame:
    """query_id, entry, score, hit: the cached (entry, vector, saved) nearest to each (query_id, q) among entries younger than `hours`."""
    young = cache.filter(F.col("saved") > now - F.make_dt_interval(hours=F.lit(hours)))
    best = dense(young, queries, 1, "entry", "vector", itself=True)
    return best.select("query_id", "entry", "score", (F.col("score") >= least).alias("hit"))


def diverse(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """Re-ranked candidates (query_id, chunk_id, source, department, content_key, score, wanted).

    The best row of a wanted department stays; a source has two rows at most,
    and more only within the margin of the best; equal contents appear once.
    """
    best = Window.partitionBy("query_id")
    once = Window.partitionBy("query_id", "content_key").orderBy(F.col("score").desc(), "chunk_id")
    rows = candidates.withColumn("copy", F.row_number().over(once)).filter("copy = 1").drop("copy")
    force = Window.partitionBy("query_id", "department").orderBy(F.col("score").desc(), "chunk_id")
    rows = rows.withColumn("forced", F.col("wanted") & (F.row_number().over(force) == 1)).withColumn("best", F.max("score").over(best))
    source = Window.partitionBy("query_id", "source").orderBy(F.col("forced").desc(), F.col("score").desc(), "chunk_id")
    kept = rows.withColumn("rn", F.row_number().over(source)).filter(F.col("forced") | (F.col("rn") <= A_SOURCE) | (F.col("score") >= F.col("best") - MARGIN))
    return ranked(kept.drop("rn", "best"), [F.col("forced").desc(), F.col("score").desc(), F.col("chunk_id")], top)


def score_gate(scored: DataFrame) -> DataFrame:
    """Rows (query_id, chunk_id, score) up to the widest gap of scores, with a floor, a least and a most."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    whole = Window.partitionBy("query_id")
    rows = scored.withColumn("pos", F.row_number().over(w)).withColumn("gap", F.lag("score").over(w) - F.col("score"))
    total, above = F.count("*").over(whole), F.sum((F.col("score") >= FLOOR).cast("int")).over(whole)
    rows = rows.withColumn("n", F.greatest(F.least(F.lit(LEAST_KEPT), total), above)).withColumn("zero", F.max(F.abs("score")).over(whole) == 0)
    inside = (F.col("pos") > LEAST_KEPT) & (F.col("pos") <= F.col("n"))
    widest = F.max(F.when(inside, F.struct("gap", (-F.col("pos")).alias("at")))).over(whole)
    rows = rows.withColumn("w", widest)
    cut = F.when(F.col("w.gap") >= CLIFF, -F.col("w.at") - 1).otherwise(F.col("n"))
    return rows.filter(F.col("zero") | (F.col("pos") <= F.least(cut, F.lit(MOST_KEPT)))).select("query_id", "chunk_id", "score", F.col("pos").cast("bigint").alias("pos"))


def demoted(scored: DataFrame, is_furniture: Column) -> DataFrame:
    """Furniture after the rest in its own order; unchanged where all or none is furniture."""
    whole = Window.partitionBy("query_id")
    rows = scored.withColumn("f", is_furniture)
    both = F.max(F.col("f").cast("int")).over(whole) != F.min(F.col("f").cast("int")).over(whole)
    rows = rows.withColumn("late", both & F.col("f"))
    return rows.withColumn("new_rank", F.row_number().over(whole.orderBy("late", "rank")).cast("bigint"))


def content_words(text: Column, stop: list[str]) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def parent_swap(rows: DataFrame, stop: list[str]) -> DataFrame:
    """Children (query_id, ord, score, child, parent_id, parent) with parents put in where they are an upgrade.

    A parent stands in for its children from the first that passes the gates: it
    is over 1.2 times as long; where the child has detail of its own the parent
    has 200 characters; a parent under 200 shares three tenths of the child's
    words. A child with detail stays beside its parent, which then counts 0.01 less.
    """
    adds = F.col("child").rlike(DETAIL) & ~F.contains("parent", F.regexp_extract("child", DETAIL, 0))
    words = content_words(F.col("child"), stop)
    shared = F.size(F.array_intersect(words, content_words(F.col("parent"), stop)))
    topical = (F.length("parent") >= 200) | (F.size(words) == 0) | (shared >= 0.3 * F.size(words))
    upgrade = F.col("parent").isNotNull() & (F.length("parent") > 1.2 * F.length("child")) & (~adds | (F.length("parent") >= 200)) & topical
    told = rows.withColumn("adds", F.coalesce(adds, F.lit(False))).withColumn("up", F.coalesce(upgrade, F.lit(False)))
    family = Window.partitionBy("query_id", "parent_id")
    told = told.withColumn("acc", F.min(F.when(F.col("up"), F.col("ord"))).over(family))
    after = F.col("acc").isNotNull() & (F.col("ord") >= F.col("acc"))
    loose = told.filter(~after | F.col("adds")).select("query_id", F.col("child").alias("text"), "score", "ord", F.lit("child").alias("kind"))
    parents = told.filter(after).groupBy("query_id", "parent_id").agg(
        F.max(F.col("score") - F.when(F.col("adds"), 0.01).otherwise(0.0)).alias("score"), F.first("parent").alias("text"), F.min("acc").alias("ord")
    )
    union = loose.unionByName(parents.select("query_id", "text", "score", "ord", F.lit("parent").alias("kind")))
    first = Window.partitionBy("query_id", F.md5(T.folded(F.lower("text")).cast("binary"))).orderBy("ord", "kind")
    return union.withColumn("copy", F.row_number().over(first)).filter("copy = 1").drop("copy")


def context(ranked_rows: DataFrame, source: str, text: str) -> DataFrame:
    """query_id, context: the texts in order of rank, each under its source."""
    part = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit(": "), F.col(source), F.lit("]\n"), F.col(text))
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return ranked_rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n---\n").alias("context"))


def hit_and_reciprocal(expected: DataFrame, found: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Hit at k and mean reciprocal rank over all queries; one without a result counts as zero."""
    first = expected.join(found, ["query_id", key], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    none = expected.select("query_id").distinct().join(found.select("query_id").distinct(), "query_id", "left_anti").agg(F.count("*").alias("zero_results"))
    out = first.agg(
        F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias("hit_at_k"),
        F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
        F.count("*").alias("n_queries"),
    )
    return out.crossJoin(none)

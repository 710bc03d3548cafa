"""Search queries: BM25, vectors, fusion, gates, parents, evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loamix.operators import retrieval as R
from loamix.plans import table
from loamix.sources import scratch

STOP = ["the", "and", "for", "with", "that", "this", "are", "was", "from", "les", "des", "que", "der", "die", "und", "los", "las"]


_INDEXES: dict = {}


def index(spark, sf_dir):
    """The stored index of the documents, written once a session and folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES:
        made = R.index_of(table(spark, sf_dir, "documents"), carry=("lang",))
        _INDEXES[at] = made.save(f"{scratch.root(spark)}/index-{uuid.uuid4().hex}")
    return _INDEXES[at]


def questions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_rows(spark, sf_dir, top=10, within=None):
    return R.bm25_search(index(spark, sf_dir), questions(spark, sf_dir), top, within)


def q_bm25_topk(spark, sf_dir):
    return bm25_rows(spark, sf_dir)


def dense_rows(spark, sf_dir, top=10):
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return R.dense(vecs, vecs.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), top)


def q_dense_topk(spark, sf_dir):
    return dense_rows(spark, sf_dir)


def q_cache_lookup(spark, sf_dir):
    """Best cached vector of each query, with a hit from the threshold on; entries live for a day."""
    vecs = table(spark, sf_dir, "embeddings")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    cache = vecs.select(F.col("vec_id").alias("entry"), F.col("embedding").alias("vector"), F.timestamp_add("HOUR", (F.col("vec_id") % 48).cast("int"), start).alias("saved"))
    asked = vecs.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return R.cache_lookup(cache, asked, F.timestamp_add("HOUR", F.lit(47), start))


def two_lists(spark, sf_dir):
    """Two ranked lists for each passage: BM25, and documents by a fixed other order."""
    a = bm25_rows(spark, sf_dir, 10).select("query_id", F.lit(0).alias("list_no"), "rank", "doc_id")
    b = a.select("query_id", F.lit(1).alias("list_no"), (11 - F.col("rank")).alias("rank"), F.when(F.col("rank") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 100000).alias("doc_id"))
    return a.unionByName(b)


def q_rrf(spark, sf_dir):
    return R.rrf(two_lists(spark, sf_dir), "doc_id", 10)


def q_interleave(spark, sf_dir):
    return R.interleaved(two_lists(spark, sf_dir), "doc_id", 8).select("query_id", "doc_id", "list_no", "rank")


def q_hybrid_quota(spark, sf_dir):
    """A quota of the best for each category, fused by taking turns over categories."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = bm25_rows(spark, sf_dir, 200).select("query_id", "doc_id", "score").join(docs, "doc_id")
    return R.quota_by(rows, "lang", "doc_id", 5, 12)


def candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows = bm25_rows(spark, sf_dir, 40).select("query_id", "doc_id", "score").join(docs, "doc_id")
    return rows.select("query_id", F.col("doc_id").alias("chunk_id"), "source", F.col("lang").alias("department"), F.md5(F.col("text").cast("binary")).alias("content_key"), "score", (F.col("lang") == "fr").alias("wanted"))


def q_diversity(spark, sf_dir):
    return R.diverse(candidates(spark, sf_dir)).select("query_id", "chunk_id", "forced", "score", "rank")


def q_score_gate(spark, sf_dir):
    rows = candidates(spark, sf_dir).select("query_id", "chunk_id", (F.col("score") - 12).alias("score"))
    return R.score_gate(rows).withColumn("score", F.round("score", 6))


def q_demote(spark, sf_dir):
    rows = bm25_rows(spark, sf_dir, 10)
    return R.demoted(rows, F.col("doc_id") % 3 == 0).select("query_id", "doc_id", "new_rank")


def children(spark, sf_dir):
    """The best documents' lines as children of their documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("parent"))
    rows = bm25_rows(spark, sf_dir, 6).join(docs, "doc_id")
    lines = rows.select("query_id", F.col("doc_id").alias("parent_id"), "score", "rank", "parent", F.posexplode(F.split("parent", "\n")).alias("p", "child"))
    child = F.when((F.col("p") == 1) & (F.col("parent_id") % 2 == 0), F.concat("child", F.lit(" Mail a@b.org now"))).otherwise(F.col("child"))
    return lines.select("query_id", (F.col("rank") * 100000 + F.col("p")).alias("ord"), (F.col("score") - F.col("p") * 0.5).alias("score"), child.alias("child"), "parent_id", "parent").filter("child <> ''")


def q_parent_swap(spark, sf_dir):
    out = R.parent_swap(children(spark, sf_dir), STOP)
    return out.select("query_id", F.col("ord").cast("bigint").alias("ord"), "kind", F.round("score", 6).alias("score"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_context_string(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = bm25_rows(spark, sf_dir, 5).join(docs, "doc_id")
    return R.context(rows, "source", "text").select("query_id", F.md5(F.col("context").cast("binary")).alias("context_md5"))


def q_source_caps(spark, sf_dir):
    """At most three chunks of a source for each query, and the first of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = bm25_rows(spark, sf_dir, 50).select("query_id", "doc_id", "score").join(docs, "doc_id")
    return R.ranked(rows, [F.col("score").desc(), F.col("doc_id")], 3, ["query_id", "source"]).select("query_id", "source", "doc_id", "rank")


def expected(spark, sf_dir):
    """Documents that hold a passage's first 60 characters."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 60).alias("head"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(F.broadcast(items), F.contains("text", F.col("head"))).select("query_id", "doc_id")


def q_eval_hit_mrr(spark, sf_dir):
    return R.hit_and_reciprocal(expected(spark, sf_dir), bm25_rows(spark, sf_dir).select("query_id", "doc_id", "rank"), "doc_id")


def q_retrieval_quality(spark, sf_dir):
    """Good, partial, poor or empty for every query, also those without results."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    best = bm25_rows(spark, sf_dir).groupBy("query_id").agg((F.max("score") / 100).alias("best"))
    grade = F.when(F.col("best").isNull(), "empty").when(F.col("best") > 0.5, "good").when(F.col("best") > 0, "partial").otherwise("poor")
    return asked.join(best, "query_id", "left").select("query_id", grade.alias("grade"))


BM25 = r"""toks AS (SELECT doc_id, regexp_split_to_array(trim(lower(text)), '\s+') AS w FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY doc_id, term),
tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM toks),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post, tot GROUP BY term, n),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_split_to_array(trim(lower(text)), '\s+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5 * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
           FROM asked JOIN idf USING (term) JOIN post USING (term), tot GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)"""
COS = """vecs AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"""
LISTS = f"""{BM25}, lists AS (SELECT query_id, 0 AS list_no, rank, doc_id FROM best WHERE rank <= 10 UNION ALL
  SELECT query_id, 1, 11 - rank, CASE WHEN rank % 2 = 0 THEN doc_id ELSE doc_id + 100000 END FROM best WHERE rank <= 10)"""
CANDS = f"""{BM25}, cands AS (SELECT query_id, doc_id AS chunk_id, source, lang AS department, md5(text) AS content_key, score, lang = 'fr' AS wanted
  FROM best JOIN documents USING (doc_id) WHERE rank <= 40)"""
_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_WORDS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(" + _STOPS + ", w)))"
_DETAIL = R.DETAIL

SQL = {
    "q_bm25_topk": f"WITH {BM25} SELECT query_id, doc_id, score, rank FROM best WHERE rank <= 10",
    "q_dense_topk": f"""WITH {COS}, p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM vecs a, vecs b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10""",
    "q_cache_lookup": f"""WITH {COS}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS entry, round(list_cosine_similarity(a.e, b.e), 6) AS score
          FROM vecs a, vecs b WHERE a.vec_id % 20 = 0 AND b.vec_id % 48 > 23)
        SELECT query_id, entry, score, score >= 0.9 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry) AS r FROM p) WHERE r = 1""",
    "q_rrf": f"""WITH {LISTS}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank - 1)), 9) AS score FROM lists GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""",
    "q_interleave": f"""WITH {LISTS}, once AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank, list_no) AS s FROM lists)
        SELECT query_id, doc_id, list_no, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, list_no) AS r FROM once WHERE s = 1) WHERE r <= 8""",
    "q_hybrid_quota": f"""WITH {BM25}, q AS (SELECT query_id, doc_id, lang, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, doc_id) AS k FROM best JOIN documents USING (doc_id) WHERE rank <= 200)
        SELECT query_id, doc_id, lang, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, lang) AS r FROM q WHERE k <= 5) WHERE r <= 12""",
    "q_diversity": f"""WITH {CANDS}, once AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_key ORDER BY score DESC, chunk_id) AS c FROM cands),
        f AS (SELECT *, wanted AND row_number() OVER (PARTITION BY query_id, department ORDER BY score DESC, chunk_id) = 1 AS forced, max(score) OVER (PARTITION BY query_id) AS b FROM once WHERE c = 1),
        s AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY forced DESC, score DESC, chunk_id) AS rn FROM f)
        SELECT query_id, chunk_id, forced, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY forced DESC, score DESC, chunk_id) AS rank
          FROM s WHERE forced OR rn <= 2 OR score >= b - 2.0) WHERE rank <= 10""",
    "q_score_gate": f"""WITH {CANDS}, s AS (SELECT query_id, chunk_id, score - 12 AS score FROM cands),
        p AS (SELECT *, row_number() OVER w AS pos, lag(score) OVER w - score AS gap, count(*) OVER (PARTITION BY query_id) AS total,
                sum((score >= -7.0)::INT) OVER (PARTITION BY query_id) AS above, max(abs(score)) OVER (PARTITION BY query_id) = 0 AS zero
              FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id)),
        n AS (SELECT *, greatest(least(3, total), above) AS n FROM p),
        g AS (SELECT query_id, first(gap ORDER BY gap DESC, pos) AS gap, first(pos ORDER BY gap DESC, pos) AS spot FROM n WHERE pos > 3 AND pos <= n GROUP BY query_id)
        SELECT query_id, chunk_id, round(score, 6) AS score, pos FROM n LEFT JOIN g USING (query_id)
        WHERE zero OR pos <= least(CASE WHEN g.gap >= 2.0 THEN spot - 1 ELSE n END, 8)""",
    "q_demote": f"""WITH {BM25}, f AS (SELECT query_id, doc_id, rank, doc_id % 3 = 0 AS f FROM best WHERE rank <= 10),
        l AS (SELECT *, f AND max(f::INT) OVER (PARTITION BY query_id) <> min(f::INT) OVER (PARTITION BY query_id) AS late FROM f)
        SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS new_rank FROM l""",
    "q_parent_swap": rf"""WITH {BM25}, d AS (SELECT query_id, doc_id AS parent_id, score, rank, text AS parent FROM best JOIN documents USING (doc_id) WHERE rank <= 6),
        l AS (SELECT query_id, parent_id, score, rank, parent, unnest(string_split(parent, chr(10))) AS c, generate_subscripts(string_split(parent, chr(10)), 1) - 1 AS p FROM d),
        ch AS (SELECT query_id, rank * 100000 + p AS ord, score - p * 0.5 AS score, CASE WHEN p = 1 AND parent_id % 2 = 0 THEN c || ' Mail a@b.org now' ELSE c END AS child, parent_id, parent FROM l),
        w AS (SELECT *, {_WORDS.format('child')} AS cw, {_WORDS.format('parent')} AS pw,
                regexp_matches(child, '{_DETAIL}') AND NOT contains(parent, regexp_extract(child, '{_DETAIL}')) AS adds FROM ch WHERE child <> ''),
        u AS (SELECT *, length(parent) > 1.2 * length(child) AND (NOT adds OR length(parent) >= 200)
                AND (length(parent) >= 200 OR len(cw) = 0 OR len(list_intersect(cw, pw)) >= 0.3 * len(cw)) AS up FROM w),
        a AS (SELECT *, min(CASE WHEN up THEN ord END) OVER (PARTITION BY query_id, parent_id) AS acc FROM u),
        x AS (SELECT query_id, child AS text, score, ord, 'child' AS kind FROM a WHERE acc IS NULL OR ord < acc OR adds
              UNION ALL SELECT query_id, any_value(parent), max(score - CASE WHEN adds THEN 0.01 ELSE 0 END), min(acc), 'parent' FROM a WHERE acc IS NOT NULL AND ord >= acc GROUP BY query_id, parent_id)
        SELECT query_id, ord::BIGINT AS ord, kind, round(score, 6) AS score, md5(text) AS text_md5
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY ord, kind) AS copy FROM x) WHERE copy = 1""",
    "q_context_string": f"""WITH {BM25} SELECT query_id, md5(string_agg('[Source ' || rank::VARCHAR || ': ' || source || ']' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank)) AS context_md5
        FROM best JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY query_id""",
    "q_source_caps": f"""WITH {BM25}, c AS (SELECT query_id, source, doc_id, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS r FROM best JOIN documents USING (doc_id) WHERE rank <= 50)
        SELECT query_id, source, doc_id, r AS rank FROM c WHERE r <= 3""",
    "q_eval_hit_mrr": f"""WITH {BM25}, e AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60))),
        f AS (SELECT e.query_id, min(rank) AS rank FROM e LEFT JOIN (SELECT * FROM best WHERE rank <= 10) b USING (query_id, doc_id) GROUP BY e.query_id)
        SELECT round(avg(coalesce((rank <= 5)::INT::DOUBLE, 0)), 6) AS hit_at_k, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, count(*) AS n_queries,
          (SELECT count(DISTINCT query_id) FROM e WHERE query_id NOT IN (SELECT query_id FROM best)) AS zero_results FROM f""",
    "q_retrieval_quality": f"""WITH {BM25}, m AS (SELECT query_id, max(score) / 100 AS b FROM best GROUP BY query_id)
        SELECT item_id AS query_id, CASE WHEN b IS NULL THEN 'empty' WHEN b > 0.5 THEN 'good' WHEN b > 0 THEN 'partial' ELSE 'poor' END AS grade FROM benchmark LEFT JOIN m ON item_id = query_id""",
}

QUERIES = {name: globals()[name] for name in SQL}

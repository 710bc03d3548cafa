"""Reports, reply parsing and ranking variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamix.operators import graph as G
from loamix.operators import reports as P
from loamix.operators import scorers
from loamix.plans import NORM, table
from loamix.plans.searching import BM25, bm25_rows
from loamix.plans.serving import EXTRACT, extractions


def q_reply_parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r'["\\\n]', " ").alias("t"))
    i = F.col("doc_id") % 3
    reply = F.when(i == 0, F.concat(F.lit('```json\n{"intent": "fees", "answer": "'), "t", F.lit('"}\n```'))).when(i == 1, F.concat(F.lit('{"intent":"policy","answer":"'), "t", F.lit('"}'))).otherwise(F.concat(F.lit("INTENT: campus\nANSWER: "), "t"))
    s = P.tagged_reply(reply)
    return docs.select("doc_id", s["intent"].alias("intent"), F.trim(s["answer"]).alias("answer"))


def q_extractor_loss(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return P.extractor_loss(lines, lines.filter("pos % 3 <> 1"), "doc_id")


def q_request_gaps(spark, sf_dir):
    return P.smallest_gap(table(spark, sf_dir, "events"), "event_type", "ts", "event_id")


def q_stable_runs(spark, sf_dir):
    return P.stable_runs(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", F.col("event_type"), 3)


def q_community_inputs(spark, sf_dir):
    entities, relations = extractions(spark, sf_dir)
    nodes = G.build_nodes(entities, relations)
    out = P.community_inputs(G.build_edges(relations), nodes.select(F.col("name").alias("node"), F.col("type").alias("community")))
    return out.select("community", "n_lines", F.md5(F.col("lines").cast("binary")).alias("lines_md5"))


def q_multi_intent(spark, sf_dir):
    rows = bm25_rows(spark, sf_dir, 12)
    scored = rows.select(F.floor(F.col("query_id") / 3).alias("query_id"), (F.col("query_id") % 3).alias("intent_no"), F.col("doc_id").alias("chunk_id"), (F.col("score") - 30).alias("score"))
    return P.by_intent(scored)


def q_order_unscored(spark, sf_dir):
    rows = bm25_rows(spark, sf_dir, 10).select("query_id", F.col("doc_id").alias("chunk_id"), "score")
    return P.ordered_unscored(rows, F.col("query_id") % 2 == 0, F.col("chunk_id") % 5 == 0, F.when(F.col("chunk_id") % 4 == 0, 8.0).otherwise(0.0))


def q_graded(spark, sf_dir):
    """Whether each found document is kept by the grader; those without a grade stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = bm25_rows(spark, sf_dir, 5).join(docs, "doc_id").join(asked, "query_id")
    grade = scorers.column(scorers.grade, "string")(F.col("query"), F.col("text"))
    return rows.select("query_id", "doc_id", grade.alias("grade")).withColumn("kept", F.coalesce(F.col("grade") != "NO", F.lit(True)))


def q_propositions(spark, sf_dir):
    from loamix.operators import chunking

    docs = table(spark, sf_dir, "documents").select(F.sha1(F.col("text").cast("binary")).alias("parent_id"), F.col("text").alias("content")).distinct()
    out = chunking.propositions(docs.filter("length(content) >= 30"), scorers.column(scorers.statements, "string")(F.col("content")))
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("parent_id").alias("n_parents"))


SQL = {
    "q_reply_parse": r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'fees' WHEN 1 THEN 'policy' ELSE 'campus' END AS intent, trim(regexp_replace(text, '["\\\n]', ' ', 'g')) AS answer FROM documents""",
    "q_extractor_loss": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
        k AS (SELECT doc_id, pos, {NORM.format('line')} AS key FROM l), a AS (SELECT DISTINCT doc_id, key FROM k WHERE length(key) >= 15), b AS (SELECT DISTINCT doc_id, key FROM k WHERE pos % 3 <> 1)
        SELECT a.doc_id, count(*) AS n_old, count(*) FILTER (WHERE b.key IS NULL) AS n_lost FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.key = b.key GROUP BY a.doc_id""",
    "q_request_gaps": """WITH g AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events)
        SELECT event_type, count(*) AS n, (min(gap) // 1000)::BIGINT AS gap_ms FROM g GROUP BY event_type""",
    "q_stable_runs": """WITH c AS (SELECT *, coalesce((event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id))::INT, 0) AS c FROM events), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c),
        s AS (SELECT user_id, run, count(*) AS n, min(event_id) AS f FROM r GROUP BY ALL) SELECT user_id, min(f) AS first_at FROM s WHERE n >= 3 GROUP BY user_id""",
    "q_community_inputs": f"""WITH {EXTRACT}, i AS (SELECT e.src, e.dst, e.relation, a.type AS community, row_number() OVER (PARTITION BY a.type ORDER BY e.src, e.dst) AS r FROM edges e JOIN nodes a ON e.src = a.name JOIN nodes b ON e.dst = b.name WHERE a.type = b.type)
        SELECT community, count(*) AS n_lines, md5(string_agg(src || ' ' || relation || ' ' || dst, chr(10) ORDER BY r)) AS lines_md5 FROM i WHERE r <= 20 GROUP BY community""",
    "q_multi_intent": f"""WITH {BM25}, s AS (SELECT query_id // 3 AS query_id, query_id % 3 AS intent_no, doc_id AS chunk_id, score - 30 AS score FROM best WHERE rank <= 12), f AS (SELECT * FROM s WHERE score >= -7.0),
        n AS (SELECT query_id, count(DISTINCT intent_no) AS n FROM f GROUP BY query_id), p AS (SELECT f.*, n, row_number() OVER (PARTITION BY f.query_id, intent_no ORDER BY score DESC, chunk_id) AS place FROM f JOIN n USING (query_id)),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY place, intent_no) AS copy FROM p WHERE place <= greatest(2, 8 // n))
        SELECT query_id, intent_no, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, intent_no) AS rank FROM o WHERE copy = 1) WHERE rank <= 8""",
    "q_order_unscored": f"""WITH {BM25}, v AS (SELECT query_id, doc_id AS chunk_id, score - CASE WHEN doc_id % 4 = 0 THEN 8.0::DOUBLE ELSE 0 END + CASE WHEN query_id % 2 = 0 AND doc_id % 5 = 0 THEN 4.0::DOUBLE ELSE 0 END AS v FROM best WHERE rank <= 10)
        SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(v, 6) DESC, chunk_id) AS rank FROM v""",
}
ROWS_ONLY = ("q_graded", "q_propositions")
QUERIES = {name: globals()[name] for name in (*SQL, *ROWS_ONLY)}

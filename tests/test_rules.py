"""Rules on pages and answers, stored indexes and graphs, on small cases."""

import random
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from loamix import catalogue
from loamix.functions import text
from loamix.operators import agents, dialogue, graph, pages, retrieval, tables
from loamix.sources import scratch


def values(spark, column, cases):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r["y"] for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_page_rules(spark):
    assert values(spark, pages.fetch_reason, [None, " ", "Oops! gone", "short", "word " * 30]) == ["unreachable", "empty", "dead", "too_short", "ok"]
    assert values(spark, pages.contact_label, ["a@b.org", "+12 345 678 9012", "example.edu", "Main Road 5"]) == ["Email", "Phone", "Website", "Address"]
    assert values(spark, lambda x: pages.page_title(x, F.lit("https://x.org/a/our-news")), ["#\n# Head\nx", "First line\nx", "| a |\nx", "", "y" * 81]) == ["Head", "First line", "Our News", "Our News", "Our News"]
    assert values(spark, pages.is_boilerplate, ["College, Road. Phone: 1", "The phone is 1", "Dean Office phone 1", "page not found", "x@y " * 90]) == [True, False, False, True, False]
    loss = lambda q: values(spark, lambda x: pages.boilerplate_penalty(F.lit(q), x), ["College. Phone: 1", "oops"])
    assert loss("who is the dean") == [8.0, 8.0] and loss("which phone number") == [0.0, 8.0]
    found = values(spark, pages.counts_in, ["18 Programs\n11+\nDepartments\nEvents (4) and Labs (5)\n18 Programs", "2024 was good"])
    assert [[tuple(c) for c in x] for x in found] == [[("Programs", 18), ("Departments", 11), ("Events", 4), ("and Labs", 5)], []]


def test_word_edges_of_furniture(spark):
    """An accented letter ends a word, as in the SQL; \u017f and \u212a are letters of either case."""
    told = ["xñdo a@b.org", "doó a@b.org", "xdo a@b.org", "é404ö", "x404ö", "wa\u017f a@b.org", "i\u017f a@b.org", "can\u2019t \u212a a@b.org", "bac\u212a to home"]
    dead = text.DEAD_PAGE.replace("'", "''")
    assert values(spark, pages.is_boilerplate, told) == [duckdb.execute(f"SELECT regexp_matches($1, '{dead}') OR (regexp_matches($1, '{pages.CONTACT_SIGNAL}') AND NOT regexp_matches($1, '{pages.VERB}'))", [x]).fetchone()[0] for x in told]
    assert values(spark, pages.is_boilerplate, told[:4]) == [False, False, True, True]


def test_found_furniture_keeps_its_score(spark, tmp_path):
    """The SQL lowers every fourth document only, also if another is found that is an error page or a block of contact fields."""
    texts = ["plain words here", "zebra oops", "zebra phone: 12", "zebra crossing over there", "zebra", "other", *["filler text"] * 12]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zebra oops")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rows = catalogue.QUERIES["q_penalised"](spark, str(tmp_path)).select("query_id", "doc_id", "score", "rank").collect()
    assert sorted(map(tuple, rows)) == sorted(con.execute(catalogue.SQL["q_penalised"]).fetchall())


def test_links(spark):
    base, home = F.lit("https://www.x.org/a/b.html?q=1"), F.lit("x.org")
    told = values(spark, lambda h: pages.clean_link(h, base, home)["url"], ["c/", "../d.pdf#p", "/E/", "//x.org/f", "https://y.org/", "?p=2", "mailto:a@b", "i.png", "g.docx", "#top"])
    assert told == ["https://x.org/a/c", "https://x.org/d.pdf", "https://x.org/E", "https://x.org/f", None, None, None, None, None, "https://x.org/a/b.html"]


def test_intents(spark):
    ask = lambda q: values(spark, dialogue.sub_questions, [q])[0]
    assert ask("Who is the VC, the Registrar, and the HOD of CS?") == ["Who is the VC", "Who is the Registrar", "Who is the HOD of CS"]
    assert ask("Who is the VC, what is the policy, where is the campus?") == ["Who is the VC", "what is the policy", "where is the campus"]
    assert ask("entry requirements for BS and MS programs") == [] and ask("Who is the dean") == []
    assert ask("open the merit list today and close old admission portal") == ["open the merit list today", "close old admission portal"]


def test_answer_rules(spark):
    text = [("Dr. A Khan is the Registrar.",), ("The Registrar met Mr. Ali.",), ("Registrar office",), ("nothing",)]
    frame = spark.createDataFrame([(i, t[0]) for i, t in enumerate(text)], "doc_id long, text string")
    assert [(r["doc_id"], r["tier"]) for r in agents.role_holders(frame, ["Registrar"]).orderBy("rank").collect()] == [(0, 0), (1, 1), (2, 2)]
    assert values(spark, agents.asked_populations, ["How many students and labs?", "How many departments and students", "collaborations"]) == [["student", "lab"], [], []]
    judged = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)], "query_id long, rank long, relevant boolean")
    assert {r["query_id"]: r["precision"] for r in agents.context_precision(judged).collect()} == {1: round((1 + 2 / 3) / 2, 6), 2: 0.0}
    assert values(spark, lambda x: agents.reflection(x)["grounded"], ['{"grounded": false}', "no json", None]) == [False, True, True]


def test_word_edges_of_populations(spark):
    """An accented letter ends a word, as in the SQL."""
    asked = ["How many students at échairé", "how many labé", "how many xlab", "how many flabs élab"]
    assert values(spark, agents.asked_populations, asked) == [[], ["lab"], [], ["lab"]]


def test_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "CHUNK_BLOCK", 4)
    rng = random.Random(1)
    vecs = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3 if i % 9 else 4)]) for i in range(40)] + [(40, None), (41, [0.0, 0.0, 0.0]), (42, [])]
    frame = spark.createDataFrame(vecs, "vec_id long, embedding array<float>")
    asked = frame.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {}
    for r in retrieval.dense(frame, asked, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vecs if v and any(v)}
    for q in range(0, 40, 5):
        want = sorted(((-round(float(unit[q] @ v), 6), i) for i, v in unit.items() if i != q and len(v) == len(unit.get(q, []))), key=lambda x: (x[0] + 0.0, x[1]))[:6] if q in unit else []
        assert [(i, -s + 0.0) for s, i in want] == got.get(q, [])


def test_stored_index_and_graph(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 4} " * (1 + i % 3), "ab"[i % 2]) for i in range(30)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "word1 common"), (2, "absent"), (3, "word2 word3")], "query_id long, text string")
    kept = retrieval.index_of(docs, carry=("lang",)).save(f"{tmp_path}/index")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(retrieval.bm25_search(kept, asked, 5)) == rows(retrieval.bm25(docs, asked, 5)) and kept.sizes.first()["n"] == 30
    assert {r["doc_id"] % 2 for r in retrieval.bm25_search(kept, asked, 5, F.col("lang") == "a").collect()} == {0}
    one = spark.createDataFrame([("a", "b")], "x string, y string")
    assert not scratch.graph_exists(spark, f"{tmp_path}/g")
    scratch.save_graph({name: one for name in scratch.GRAPH_TABLES}, f"{tmp_path}/g")
    assert scratch.graph_exists(spark, f"{tmp_path}/g") and scratch.load_graph(spark, f"{tmp_path}/g")["edges"].count() == 1
    scratch.delete_table(spark, f"{tmp_path}/g")
    assert not scratch.graph_exists(spark, f"{tmp_path}/g")


def test_numbered_without_one_task(spark):
    frame = spark.range(0, 500, numPartitions=7).selectExpr("id", "id % 13 AS k")
    out = graph.numbered(frame, [F.col("k").desc(), F.col("id")], "no").collect()
    assert [r["no"] for r in sorted(out, key=lambda r: (-r["k"], r["id"]))] == list(range(500))


def test_nearest_row(spark):
    cells = [(1, 0.0, 5.0, y, 2.0, "t", c) for y, c in ((0.0, 0.9), (0.5, 0.9), (10.0, 0.9), (4.0, 0.1), (6.0, 0.1), (5.125, 0.1))]
    frame = spark.createDataFrame(cells, "page_id long, x0 double, x1 double, y double, h double, text string, conf double")
    assert {r["y"]: r["row_no"] for r in tables.nearest_row(frame).collect()} == {0.0: 0, 0.5: 0, 10.0: 1, 4.0: 0, 6.0: 1, 5.125: 0}


def test_nearest_row_of_a_long_page(spark):
    """30,000 rows of a page: a window that is open at its end reads as many rows again for each cell."""
    n = 30_000
    frame = spark.range(n).select(F.lit(1).alias("page_id"), F.lit(0.0).alias("x0"), F.lit(5.0).alias("x1"), (F.col("id") * 18.0).alias("y"), F.lit(10.0).alias("h"), F.lit("t").alias("text"), F.lit(0.9).alias("conf"))
    began = time.time()
    wrong = tables.nearest_row(frame).filter("row_no <> y / 18").count()
    assert wrong == 0 and time.time() - began < 60

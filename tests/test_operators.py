"""Rules on small cases, and window forms against loops."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loamix.functions import text as T
from loamix.functions import urls as U
from loamix.operators import chunking, dialogue, furniture, graph, ingest, retrieval, scorers, tables
from loamix.plans.search import search
from loamix.sources import readers, scratch


def values(spark, column, cases, kind="string"):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r["y"] for r in frame.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text_rules(spark):
    assert values(spark, T.normalised, ["  ## Home  Page ", "• A|b", "", "#"]) == ["home page", "a|b", "", ""]
    assert values(spark, T.is_navigation_label, ["Home", "", "Call 12", "a@b", "x" * 41, "see abc.org"]) == [True, True, False, False, False, False]
    assert values(spark, T.looks_dead, ["Oops, gone", "x" * 400 + " page not found", None, "room 404 "]) == [True, False, False, True]
    assert values(spark, T.strip_image_blocks, ["a [IMAGE TEXT]b\nc[/IMAGE TEXT] d", "a [IMAGE CONTENT from u] z"]) == ["a  d", "a"]
    assert values(spark, T.doc_year, ["on 5th March 2012, revised 2020", "in 2019", "1999"]) == [2012, 2019, None]
    assert values(spark, T.section_of_chunk, ["## Fees \nx", "[Rules — continued]\ny", "plain"]) == ["Fees", "Rules", "unknown"]
    assert values(spark, T.propositions_of, ["1. Long enough one\n2) short\n\n3 - Another long one"]) == [["Long enough one", "Another long one"]]
    facts = lambda c: T.looks_like_contact_fact(c, "Example College")
    assert values(spark, facts, ["+92 824 410051", "Example College, Road, Town", "Example College", ""]) == [True, True, False, False]


def test_url_rules(spark):
    assert values(spark, U.path, ["HTTPS://X.org/A/b/?q=1#z", "http://x.org", "", None, "/faculty/"]) == ["/a/b", "/", "/", "/", "/faculty"]
    assert values(spark, U.normalised, ["http://www.x.org/a/#t", "https://x.org/a?b=1"]) == ["https://x.org/a", "https://x.org/a?b=1"]
    got = values(spark, U.category, ["https://x.org/tag/a", "https://x.org/", "https://x.org/faculty/cs", "https://x.org/conduct-rules", "https://x.org/contact-us", "https://x.org/news/page/3"])
    assert got == [None, "general", "faculty", "policy", "general", None]
    assert values(spark, U.pdf_links, ["<a href='/a.pdf#p'>x</a><a href=\"/a.pdf\">y</a>"]) == [["/a.pdf"]]


def test_redundant_propositions_against_the_loop(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.choice("xy"), rng.choice(["p", "q", "r", None])) for i in range(120)]
    frame = spark.createDataFrame(rows, "id long, text string, category string, parent_id string")
    got = {r["id"] for r in furniture.redundant_propositions(frame).filter("drop").collect()}
    left, seen, want = defaultdict(int), set(), set()
    for _, _, _, p in rows:
        left[p] += 1
    for i, t, c, p in rows:
        if (t, c) in seen and left[p] > 1:
            want.add(i)
            left[p] -= 1
        seen.add((t, c))
    assert got == want


def test_score_gate_against_the_loop(spark):
    rng = random.Random(2)
    rows = [(q, c, rng.choice([-9.0, -8.0, -7.0, -3.0, 0.0, 1.0, 2.0, 5.0]) if q else 0.0) for q in range(40) for c in range(rng.randint(1, 14))]
    got = defaultdict(int)
    for r in retrieval.score_gate(spark.createDataFrame(rows, "query_id int, chunk_id int, score double")).collect():
        got[r["query_id"]] += 1
    for q in range(40):
        scores = sorted((s for a, _, s in rows if a == q), reverse=True)
        if not any(scores):
            assert got[q] == len(scores)
            continue
        n = max(min(3, len(scores)), sum(s >= -7 for s in scores))
        gaps = [(scores[i - 1] - scores[i], -i) for i in range(3, n)]
        cut = -max(gaps)[1] if gaps and max(gaps)[0] >= 2.0 else n
        assert got[q] == min(cut, 8)


def test_negative_idf_and_zero_hits(spark):
    docs = spark.createDataFrame([(i, "common word" if i else "common rare word") for i in range(6)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "rare"), (2, "absent"), (3, "rare rare")], "query_id int, text string")
    out = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.bm25(docs, queries).collect()}
    assert set(out) == {(1, 0), (3, 0)} and abs(out[3, 0] - 2 * out[1, 0]) < 1e-5
    found = spark.createDataFrame([(1, 0, 2)], "query_id int, doc_id long, rank long")
    expected = spark.createDataFrame([(1, 0), (2, 5)], "query_id int, doc_id long")
    row = retrieval.hit_and_reciprocal(expected, found, "doc_id").first()
    assert (row["hit_at_k"], row["mrr"], row["zero_results"]) == (0.5, 0.25, 1)


def test_pieces_hold_the_text():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "a. ", "\n", "\n\n", "longerword", ", "]) for _ in range(rng.randint(0, 200)))
        parts = chunking.pieces_of(text, 50, 10)
        assert all(0 < len(p) <= 50 for p in parts)
        assert set("".join(text.split())) == set("".join("".join(parts).split())) and sum(len("".join(p.split())) for p in parts) >= len("".join(text.split())) - text.count(".")


def test_sentence_windows(spark):
    frame = spark.createDataFrame([(n, list("abcdefg")[:n]) for n in range(1, 7)], "n int, p array<string>")
    got = {r["n"]: [w.split("\n") for w in r["w"]] for r in frame.select("n", chunking.sentence_windows(F.col("p")).alias("w")).collect()}
    assert got[3] == [["a", "b", "c"]] and got[5] == [["a", "b", "c"], ["c", "d", "e"], ["e"]]


def test_graph(spark):
    entities = spark.createDataFrame([("A", "t1", "short", 1), (" ", "t", "d", 2), ("A", "t2", "longer one", 3), ("A", "t3", "longer two", 4)], "name string, type string, description string, at long")
    relations = spark.createDataFrame([("A", "r1", "B", 5), ("A", "r2", "B", 6), ("A", "", "C", 7)], "src string, relation string, dst string, at long")
    nodes = {r["name"]: (r["type"], r["description"]) for r in graph.build_nodes(entities, relations).collect()}
    assert nodes == {"A": ("t1", "longer one"), "B": ("unknown", "")}
    assert [tuple(r) for r in graph.build_edges(relations).collect()] == [("A", "B", "r2")]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d"), ("x", "y")], "src string, dst string")
    homes = {r["node"]: r["community"] for r in graph.communities(edges).collect()}
    assert homes["a"] == homes["b"] == homes["c"] != homes["d"] == homes["e"] == homes["f"] and homes["x"] == homes["y"]


def slow_modularity(edges, total):
    degree, between = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for a, b in edges:
        degree[a] += 1
        degree[b] += 1
        if a != b:
            between[a][b] += 1
            between[b][a] += 1
    home = {n: n for n in degree}
    while True:
        gains = [(2 * total * w - degree[a] * degree[b], a, b) for a in sorted(between) for b, w in sorted(between[a].items()) if a < b]
        best = max(gains, key=lambda x: x[0], default=(0,))
        if best[0] <= 0:
            return home
        _, a, b = best
        home = {n: a if c == b else c for n, c in home.items()}
        degree[a] += degree.pop(b)
        for c, w in between.pop(b).items():
            between[c].pop(b)
            if c != a:
                between[a][c] += w
                between[c][a] += w


def test_greedy_modularity_merges_the_best_pair():
    rng = random.Random(7)
    for case in range(120):
        n, lines = rng.randint(2, 50), rng.choice([2, 6, 20])
        edges = sorted({(f"d{rng.randint(0, n)}", f"k{rng.randint(0, lines)}" if case % 2 else f"d{rng.randint(0, n)}") for _ in range(rng.randint(1, 120))})
        total = len(edges) * rng.choice([1, 3])
        assert graph.greedy_modularity(edges, total) == slow_modularity(edges, total)


def test_greedy_modularity_of_large_groups():
    """Two lines that thousands of documents share: a search of all pairs at each merge takes hours."""
    edges = [(f"d{i:05d}", f"k{i // 4000}") for i in range(8000)] + [("d00000", "k1")]
    began = time.process_time()
    homes = graph.greedy_modularity(edges, len(edges))
    assert len(set(homes.values())) == 2 and homes["d00001"] == homes["k0"] != homes["k1"] == homes["d07999"]
    assert time.process_time() - began < 30


def test_ingest(spark):
    old = spark.createDataFrame([("same", "text"), ("changed", "old"), ("image", "body"), ("gone", "kept")], "source string, text string")
    stored = ingest.with_page_hash(old).select("source", "page_hash")
    new = spark.createDataFrame([("same", "text"), ("changed", "new"), ("image", "body [IMAGE TEXT]x[/IMAGE TEXT]"), ("fresh", "f"), ("blank", " ")], "source string, text string")
    got = {r["source"]: r["status"] for r in ingest.statuses(stored, new).collect()}
    assert got == {"same": "skipped", "changed": "updated", "image": "skipped", "fresh": "added", "blank": "empty"}
    assert ingest.upserted(stored, new).count() == 5


def test_dialogue(spark):
    turns = spark.createDataFrame(
        [(1, 1, "user", "hostel fee rules"), (1, 2, "assistant", "..."), (1, 3, "user", "tell me more"), (1, 4, "user", "what is it?"), (2, 1, "user", "what is it?"), (2, 2, "user", "a whole question about the library")],
        "conv_id int, turn int, role string, text string",
    )
    got = {(r["conv_id"], r["turn"]): r["resolved"] for r in dialogue.follow_ups(turns).collect()}
    assert got[1, 3] == "tell me more (in the context of: hostel fee rules)" and got[2, 1] == "what is it?" and got[2, 2] == "a whole question about the library"
    assert values(spark, dialogue.route, ["who reports to whom, report to whom", "2 + 2", "the attendance rule", "library and fee", "%%%%", "readmission"]) == ["general", "out_of_scope", "policy", "general", "out_of_scope", "policy"]
    assert values(spark, dialogue.is_small_talk, ["Hi there", "vehicles", "", "many thanks"]) == [True, False, True, True]


def test_tables(spark):
    cells = [(1, 0.0, 50.0, 0.0, 10.0, "Name", 0.9), (1, 90.0, 140.0, 1.0, 10.0, "Fee", 0.9), (1, 0.0, 50.0, 20.0, 10.0, "Bus", 0.9), (1, 91.0, 140.0, 20.0, 10.0, "100", 0.9), (1, 90.0, 140.0, 40.0, 10.0, "a term", 0.9), (1, 0.0, 9.0, 60.0, 10.0, "ghost", 0.1)]
    frame = spark.createDataFrame(cells, "page_id long, x0 double, x1 double, y double, h double, text string, conf double")
    assert tables.reconstruct(frame).first()["table_text"] == "| Name | Fee |\n| Bus | 100 a term |"
    gaps = spark.createDataFrame([(1, v) for v in (0.0, 1.0, 3.0, 5.1)], "g int, v double")
    assert [r["c"] for r in tables.gap_clusters(gaps, ["g"], F.col("v"), F.lit(2.0), "c").orderBy("v").collect()] == [0, 0, 0, 1]


def test_readers_and_versions(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("﻿address,category,keep\n https://x.org/a ,policy,yes\nhttps://x.org/a/,policy,yes\nhttps://x.org/b,nope,no\n", encoding="utf-8")
    rows = readers.url_list(spark, str(path), ["address", "category", "keep"])
    assert rows.first()["address"] == "https://x.org/a"
    assert {r["problem"] for r in readers.checked_list(rows, ["policy"]).collect()} == {"listed before", "unknown category"}
    with pytest.raises(ValueError):
        readers.url_list(spark, str(path), ["label"])
    xml = spark.createDataFrame([("<sitemapindex><loc> https://x.org/s.xml </loc></sitemapindex>",)], "xml string")
    assert [tuple(r) for r in readers.sitemap_urls(xml).collect()] == [("https://x.org/s.xml", "index")]
    base = str(tmp_path / "t")
    for n in (1, 2):
        scratch.save_version(spark.range(n), base)
    assert scratch.versions(spark, base) == [1, 2] and scratch.load_version(spark, base).count() == 2 and scratch.load_version(spark, base, 1).count() == 1


def test_whole_search(spark):
    texts = ["fees for the hostel are due", "library opening hours", "the dean of science", "bus routes and hostel rooms", "sports"]
    rows = [(i, t, f"s{i % 2}", "science" if i == 2 else "other", scorers.embed(t)) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, source string, department string, embedding array<double>")
    queries = spark.createDataFrame([(100, "hostel fees", scorers.embed("hostel fees"))], "query_id long, text string, embedding array<double>")
    out = [r["chunk_id"] for r in search(chunks, queries).orderBy("pos").collect()]
    assert out[0] == 0 and 3 in out

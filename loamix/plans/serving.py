"""Graph, crawl, dialogue, ingest, table and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamix.operators import chunking as C
from loamix.operators import crawling as W
from loamix.operators import dialogue as D
from loamix.operators import furniture as O
from loamix.operators import graph as G
from loamix.operators import ingest as I
from loamix.operators import tables as B
from loamix.plans import LINES, table


# -- chunking ---------------------------------------------------------------------------------------------------------


def headed_lines(spark, sf_dir):
    lines = O.page_lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", "line")
    return lines.withColumn("line", F.when((F.col("pos") + F.col("doc_id")) % 6 == 2, F.concat(F.lit("## "), F.col("line"))).otherwise(F.col("line")))


def q_chunk_sections(spark, sf_dir):
    out = C.sections(headed_lines(spark, sf_dir))
    return out.select("doc_id", "section_no", "heading", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def q_section_chunks(spark, sf_dir):
    out = C.section_chunks(C.sections(headed_lines(spark, sf_dir)))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.length("chunk")).alias("longest"))


def q_parents_children(spark, sf_dir):
    out = C.parents_and_children(table(spark, sf_dir, "documents"))
    return out.groupBy("doc_id").agg(F.count_distinct("parent_id").alias("n_parents"), F.count("*").alias("n_children"))


def q_sentence_window(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    windows = C.sentence_windows(F.split("text", "\n"))
    return docs.select("doc_id", F.posexplode(windows).alias("n", "w")).select("doc_id", F.col("n").cast("bigint").alias("n"), F.md5(F.col("w").cast("binary")).alias("window_md5"))


# -- graph ------------------------------------------------------------------------------------------------------------


def extractions(spark, sf_dir):
    """Entities and relations of each line, by rule: its first and last words."""
    lines = O.page_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).filter("line <> ''")
    word = lambda c: F.regexp_replace(c, "[^\\p{L}]", "")
    rows = lines.select(
        word(F.substring_index("line", " ", 1)).alias("src"), word(F.substring_index("line", " ", -1)).alias("dst"),
        F.concat(F.lit("r"), (F.col("pos") % 3).cast("string")).alias("relation"), (F.col("doc_id") * 200000 + F.col("pos")).alias("o"), F.col("line").alias("description"),
        (F.col("doc_id") % 4).cast("string").alias("type"),
    )
    entities = rows.filter("o % 2 = 0").select(F.col("src").alias("name"), F.concat(F.lit("t"), "type").alias("type"), "description", (F.col("o") * 2).alias("at"))
    return entities, rows.select("src", "dst", "relation", (F.col("o") * 2 + 1).alias("at"))


EXTRACT = r"""rows AS (SELECT regexp_replace(string_split(line, ' ')[1], '[^\p{L}]', '', 'g') AS src, regexp_replace(string_split(line, ' ')[-1], '[^\p{L}]', '', 'g') AS dst,
    'r' || (pos % 3)::VARCHAR AS relation, doc_id * 200000 + pos AS o, line AS description, 't' || (doc_id % 4)::VARCHAR AS type
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE line <> ''),
rels AS (SELECT src, dst, relation, o * 2 + 1 AS at_ FROM rows WHERE src <> '' AND dst <> ''),
named AS (SELECT src AS name, type, description, o * 2 AS at_ FROM rows WHERE o % 2 = 0 AND src <> '' UNION ALL SELECT src, 'unknown', '', at_ FROM rels UNION ALL SELECT dst, 'unknown', '', at_ FROM rels),
nodes AS (SELECT name, arg_min(type, at_) AS type, first(description ORDER BY length(description) DESC, at_) AS description FROM named GROUP BY name),
edges AS (SELECT src, dst, arg_max(relation, at_) AS relation FROM rels GROUP BY src, dst)"""


def q_graph_nodes(spark, sf_dir):
    return G.build_nodes(*extractions(spark, sf_dir))


def q_graph_edges(spark, sf_dir):
    return G.build_edges(extractions(spark, sf_dir)[1])


def line_edges(spark, sf_dir):
    """Documents tied to the lines that they share with others."""
    keys = O.page_keys(table(spark, sf_dir, "documents")).filter("length(key) > 30")
    rows = keys.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("src"), F.concat(F.lit("k"), F.md5(F.col("key").cast("binary"))).alias("dst"))
    shared = rows.groupBy("dst").agg(F.count("*").alias("df")).filter("df >= 2")
    return rows.join(shared, "dst", "left_semi").select("src", "dst")


LINE_EDGES = f"""{LINES}, links AS (SELECT DISTINCT 'd' || doc_id::VARCHAR AS a, 'k' || md5(key) AS b FROM keyed WHERE key IN (SELECT key FROM freq WHERE df >= 2 AND length(key) > 30)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(n, r) USING KEY (n) AS (SELECT DISTINCT a, a FROM ways UNION
  SELECT ways.b, min(reach.r) FROM reach JOIN ways ON reach.n = ways.a JOIN recurring.reach AS now ON now.n = ways.b AND reach.r < now.r GROUP BY ways.b),
comps AS (SELECT n AS node, r AS component FROM reach)"""


def q_components(spark, sf_dir):
    return G.components(line_edges(spark, sf_dir))


def q_component_sizes(spark, sf_dir):
    members = G.components(line_edges(spark, sf_dir)).withColumnRenamed("component", "community")
    return G.community_sizes(members)


def q_global_search(spark, sf_dir):
    return G.global_search(q_component_sizes(spark, sf_dir))


def q_communities(spark, sf_dir):
    return G.communities(line_edges(spark, sf_dir))


def q_local_search(spark, sf_dir):
    nodes, edges = G.build_nodes(*extractions(spark, sf_dir)), G.build_edges(extractions(spark, sf_dir)[1])
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    members = nodes.select(F.col("name").alias("node"), F.col("type").alias("community"))
    return G.local_search(asked, nodes, edges, members)


def q_graph_questions(spark, sf_dir):
    """Passages that name two or more entities."""
    nodes = G.build_nodes(*extractions(spark, sf_dir))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return G.entities_in(asked, nodes).groupBy("query_id").agg(F.count("*").alias("n_entities")).filter("n_entities >= 2")


def q_crawl_bfs(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    links = pages.select(F.col("page_id").alias("src"), F.explode(F.transform(F.array(F.lit(1), F.lit(2), F.lit(5)), lambda k: F.col("page_id") * 2 + k)).alias("dst"))
    known = links.join(pages.select(F.col("page_id").alias("dst")), "dst", "left_semi")
    return G.crawl(known, pages.filter("page_id % 20 = 0").select(F.col("page_id").alias("address")), 3).select("address", F.col("depth").cast("bigint").alias("depth"))


# -- crawl verdicts ---------------------------------------------------------------------------------------------------


def q_page_verdict(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    requested = F.concat(F.lit("http://www.example.org/p/"), i.cast("string"))
    final = F.when(i % 13 == 0, F.lit("https://example.org/moved")).otherwise(F.concat(F.lit("https://example.org/p/"), i.cast("string"), F.lit("/")))
    text = F.when(i % 17 == 0, F.concat(F.lit("Nothing lives here\n"), F.col("text"))).when(i % 19 == 0, F.lit("Welcome home")).otherwise(F.col("text"))
    rows = docs.select(requested.alias("requested"), final.alias("final"), text.alias("text"), (i % 23 == 0).alias("has_login"), i.alias("at"))
    return W.page_verdicts(rows, "Welcome  home", ["nothing lives here"])


def q_link_verdict(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    link = F.concat(F.lit("https://example.org/f/"), i.cast("string"), F.when(i % 3 == 0, ".pdf").when(i % 3 == 1, ".png").otherwise(""))
    final = F.when(i % 7 == 0, F.lit("https://example.org/")).when(i % 5 == 0, F.concat(link, F.lit("x"))).otherwise(link)
    kind = F.when(i % 3 == 0, "pdf").when(i % 3 == 1, "image").otherwise("page")
    ctype = F.when(i % 4 == 0, "text/html").when(i % 3 == 0, "application/pdf").when(i % 3 == 1, "image/png").otherwise("text/html")
    status = F.when(i % 11 == 0, 404).otherwise(200)
    verdict = W.link_verdict(link, final, status, ctype, kind, (i * 37) % 400)
    return pages.groupBy(verdict.alias("verdict"), kind.alias("kind")).agg(F.count("*").alias("n"))


def q_old_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    slug = F.regexp_replace(F.lower(F.regexp_extract("html", "<title>([^<]*)", 1)), "[^a-z0-9]+", "-")
    old = pages.select(F.concat(F.lit("https://example.org/old/"), slug, F.lit("-html")).alias("old")).distinct()
    new = pages.select(F.concat(F.lit("https://example.org/"), F.regexp_replace(slug, "-[a-z]*-?$", "")).alias("new")).distinct()
    return W.old_to_new(old, new)


# -- dialogue ---------------------------------------------------------------------------------------------------------

ASKED = ("what about ", "who is ", "hi ", "is it ", "how do i report ", "the fee for ", "library and fee ", "thank you ", "12 + 7 ", "")


def turns(spark, sf_dir):
    """Every sentence of every turn as a turn of its own, after the words that rules look for, put in by rule."""
    rows = table(spark, sf_dir, "conversations")
    lead = F.get(F.array(*[F.lit(a) for a in ASKED]), ((F.col("conv_id") + F.col("turn")) % len(ASKED)).cast("int"))
    said = rows.select("conv_id", "role", lead.alias("lead"), "turn", F.posexplode(F.split("text", "[.] ")).alias("p", "s"))
    return said.select("conv_id", (F.col("turn") * 100000 + F.col("p")).alias("turn"), "role", F.concat("lead", "s").alias("text"))


TURNS = f"""said AS (SELECT conv_id, turn * 100000 + generate_subscripts(string_split(text, '. '), 1) - 1 AS turn, role,
    list_extract({list(ASKED)!r}, ((conv_id + turn) % {len(ASKED)} + 1)::BIGINT) AS lead, unnest(string_split(text, '. ')) AS s FROM conversations),
turns AS (SELECT conv_id, turn, role, lead || s AS text FROM said)"""


def q_trim_history(spark, sf_dir):
    return D.last_turns(table(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role")


def q_summary_cut(spark, sf_dir):
    return D.to_summarise(table(spark, sf_dir, "conversations"), 4, 2).select("conv_id", "turn", "role")


def q_session_list(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("turn").alias("last_turn"), F.substring(F.min_by("text", F.col("turn")), 1, 50).alias("title"))


def q_followup(spark, sf_dir):
    return D.follow_ups(turns(spark, sf_dir)).select("conv_id", "turn", "resolved")


def q_chitchat(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", D.is_small_talk(F.col("text")).alias("chitchat"))


def q_route(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", D.route(F.col("text")).alias("route"))


def q_session_ttl(spark, sf_dir):
    return D.sessions(table(spark, sf_dir, "events"))


# -- ingest, tables, evaluation ---------------------------------------------------------------------------------------


def snapshots(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("source"), "doc_id", "text")
    old = I.with_page_hash(docs.filter("doc_id % 10 < 7")).select("source", F.when(F.col("doc_id") % 3 == 0, F.col("legacy_hash")).otherwise(F.col("page_hash")).alias("page_hash"))
    i = F.col("doc_id") % 10
    text = F.when(i == 1, F.concat("text", F.lit(" changed"))).when(i == 2, F.concat("text", F.lit("\n[IMAGE TEXT]x[/IMAGE TEXT]"))).when(i == 3, F.lit(" ")).otherwise(F.col("text"))
    return old, docs.filter("doc_id % 10 <> 0").select("source", text.alias("text"))


SNAPS = r"""docs AS (SELECT 'p' || doc_id::VARCHAR AS source, doc_id, text FROM documents),
old AS (SELECT source, substr(md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE trim(text) END), 1, 8) AS h FROM docs WHERE doc_id % 10 < 7),
new AS (SELECT source, CASE doc_id % 10 WHEN 1 THEN text || ' changed' WHEN 2 THEN text || chr(10) || '[IMAGE TEXT]x[/IMAGE TEXT]' WHEN 3 THEN ' ' ELSE text END AS text FROM docs WHERE doc_id % 10 <> 0),
hashed AS (SELECT source, text, substr(md5(trim(regexp_replace(text, '(?s)\[IMAGE TEXT\].*?\[/IMAGE TEXT\]', '', 'g'))), 1, 8) AS h, substr(md5(text), 1, 8) AS l FROM new),
verdicts AS (SELECT n.source, CASE WHEN trim(n.text) = '' THEN 'empty' WHEN o.source IS NULL THEN 'added' WHEN o.h = n.h OR o.h = n.l THEN 'skipped' ELSE 'updated' END AS status, n.h
  FROM hashed n LEFT JOIN old o USING (source))"""


def q_incremental_upsert(spark, sf_dir):
    return I.statuses(*snapshots(spark, sf_dir))


def q_status_counts(spark, sf_dir):
    return I.status_counts(I.statuses(*snapshots(spark, sf_dir)))


def q_upserted(spark, sf_dir):
    return I.upserted(*snapshots(spark, sf_dir))


def cells(spark, sf_dir, dealt=False):
    """Positioned words by rule: rows of a page with gaps, cells at steps. dealt: the texts are dealt by page first, so that the cells needn't be."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    words = (docs.repartition("page_id") if dealt else docs).select("page_id", F.posexplode(F.split("text", " ")).alias("p", "text"))
    row, col = F.floor(F.col("p") / 4), F.col("p") % 4
    return words.select("page_id", (col * 90 + row % 3).cast("double").alias("x0"), (col * 90 + 60).cast("double").alias("x1"), (row * 18 + col % 2).cast("double").alias("y"),
                        F.lit(10.0).alias("h"), "text", (0.1 + F.col("p") % 7 * 0.1).alias("conf"))


CELLS = """words AS (SELECT doc_id AS page_id, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM documents),
cells AS (SELECT page_id, ((p % 4) * 90 + (p // 4) % 3)::DOUBLE AS x0, ((p // 4) * 18 + (p % 4) % 2)::DOUBLE AS y, 10.0::DOUBLE AS h, text, 0.1::DOUBLE + (p % 7) * 0.1::DOUBLE AS conf FROM words),
sure AS (SELECT *, median(h) OVER (PARTITION BY page_id) AS m FROM cells WHERE conf >= 0.2),
r1 AS (SELECT *, coalesce((y + h / 2) - lag(y + h / 2) OVER (PARTITION BY page_id ORDER BY y + h / 2) > m * 0.6, false)::INT AS g FROM sure),
r2 AS (SELECT *, sum(g) OVER (PARTITION BY page_id ORDER BY y + h / 2 RANGE UNBOUNDED PRECEDING)::BIGINT AS row_no FROM r1),
c1 AS (SELECT *, coalesce(x0 - lag(x0) OVER (PARTITION BY page_id ORDER BY x0) > m * 1.5, false)::INT AS gc FROM r2),
c2 AS (SELECT *, sum(gc) OVER (PARTITION BY page_id ORDER BY x0 RANGE UNBOUNDED PRECEDING)::BIGINT AS col_no FROM c1)"""


def q_gap_cluster(spark, sf_dir):
    return B.cells_to_grid(cells(spark, sf_dir))


def q_table_regions(spark, sf_dir):
    docs = O.page_lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", "line")
    rows = docs.select(F.col("doc_id").alias("page_id"), F.col("pos").alias("row_no"), (F.length("line") > 60).alias("tabular"))
    return B.regions(rows, least=3).select("page_id", F.col("first_row").cast("bigint").alias("first_row"), "n_rows")


def q_table_text(spark, sf_dir):
    return B.reconstruct(cells(spark, sf_dir))


def q_metric_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    metric = F.when(F.col("quality") == 1, 0.5).otherwise(0.1) + F.col("n_chars") % 50 / 100.0
    bucket = F.when(metric >= 0.75, "green").when(metric >= 0.5, "amber").otherwise("red")
    return rows.groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(metric), 6).alias("mean"))


def q_label_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rows.groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def q_category_integrity(spark, sf_dir):
    """Categories written but not read, and read but not written."""
    written = table(spark, sf_dir, "documents").select(F.col("lang").alias("category")).distinct()
    read = spark.createDataFrame([("en",), ("de",), ("it",)], "category string")
    return written.join(read, "category", "left_anti").withColumn("problem", F.lit("not read")).unionByName(read.join(written, "category", "left_anti").withColumn("problem", F.lit("not written")))


_OR = lambda words, c: "(" + " OR ".join("contains(" + c + ", '" + w.replace("'", "''") + "')" for w in words) + ")"
_FOLD = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_NORMURL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '#.*$', ''), '^(?i)http://', 'https://'), '^https://(?i)www\.', 'https://'), '/+$', '')"
_LIKE = lambda c, p: f"regexp_matches({c}, '" + p.replace("'", "''") + "')"
_TOPIC = "list_distinct(list_filter(regexp_split_to_array(coalesce(list_filter(string_split({0}, '/'), lambda s: s <> '')[-1], ''), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains(" + "[" + ", ".join(f"'{w}'" for w in W.FILLER) + "]" + ", w)))"
_FAMILY = ", ".join(f"CASE WHEN {_OR(words, 'mail')} THEN '{name}' END" for name, words in D.FAMILIES.items())

SQL = {
    "q_chunk_sections": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
        h AS (SELECT doc_id, pos, CASE WHEN (pos + doc_id) % 6 = 2 THEN '## ' || line ELSE line END AS line FROM l),
        m AS (SELECT *, regexp_matches(line, '^#{1,4}\s+') AS h FROM h), s AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS section_no FROM m)
        SELECT doc_id, section_no, coalesce(max(regexp_replace(line, '^#{1,4}\s+', '')) FILTER (WHERE h), 'Introduction') AS heading,
          md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT h), '')) AS content_md5 FROM s GROUP BY doc_id, section_no""",
    "q_sentence_window": """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
        w AS (SELECT doc_id, CASE WHEN len(p) <= 3 THEN [array_to_string(p, chr(10))] ELSE list_transform(range(1, len(p) + 1, 2), lambda i: array_to_string(p[i:i + 2], chr(10))) END AS ws FROM p)
        SELECT doc_id, (generate_subscripts(ws, 1) - 1)::BIGINT AS n, md5(unnest(ws)) AS window_md5 FROM w""",
    "q_graph_nodes": f"WITH {EXTRACT} SELECT * FROM nodes",
    "q_graph_edges": f"WITH {EXTRACT} SELECT * FROM edges",
    "q_components": f"WITH RECURSIVE {LINE_EDGES} SELECT * FROM comps",
    "q_component_sizes": f"WITH RECURSIVE {LINE_EDGES} SELECT component AS community, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS community_id FROM comps GROUP BY component",
    "q_global_search": f"WITH RECURSIVE {LINE_EDGES} SELECT component AS community, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) - 1 AS community_id FROM comps GROUP BY component ORDER BY community_id LIMIT 3",
    "q_local_search": f"""WITH {EXTRACT}, f AS (SELECT item_id AS query_id, name, row_number() OVER (PARTITION BY item_id ORDER BY name) AS nth FROM nodes JOIN benchmark ON length(name) >= 5 AND contains(lower(text), lower(name))),
        a AS (SELECT * FROM f WHERE nth <= 3), o AS (SELECT query_id, nth, dst, row_number() OVER (PARTITION BY query_id, nth ORDER BY dst) AS k FROM a JOIN edges ON name = src),
        s AS (SELECT query_id, name, nth * 100 AS o FROM a UNION ALL SELECT query_id, dst, nth * 100 + k FROM o WHERE k <= 5),
        g AS (SELECT query_id, type AS community, min(o) AS o FROM s JOIN nodes USING (name) GROUP BY query_id, type)
        SELECT query_id, community, nth FROM (SELECT query_id, community, row_number() OVER (PARTITION BY query_id ORDER BY o, community) AS nth FROM g) WHERE nth <= 3""",
    "q_graph_questions": f"WITH {EXTRACT} SELECT item_id AS query_id, count(*) AS n_entities FROM nodes JOIN benchmark ON length(name) >= 5 AND contains(lower(text), lower(name)) GROUP BY item_id HAVING count(*) >= 2",
    "q_crawl_bfs": """WITH RECURSIVE links AS (SELECT page_id AS src, page_id * 2 + unnest([1, 2, 5]) AS dst FROM pages), b AS (SELECT page_id AS address, 0 AS depth FROM pages WHERE page_id % 20 = 0
          UNION SELECT dst, depth + 1 FROM b JOIN links ON src = address WHERE depth < 3 AND dst IN (SELECT page_id FROM pages))
        SELECT address, min(depth)::BIGINT AS depth FROM b GROUP BY address""",
    "q_page_verdict": rf"""WITH p AS (SELECT doc_id AS at_, 'http://www.example.org/p/' || doc_id::VARCHAR AS requested, CASE WHEN doc_id % 13 = 0 THEN 'https://example.org/moved' ELSE 'https://example.org/p/' || doc_id::VARCHAR || '/' END AS final,
          CASE WHEN doc_id % 17 = 0 THEN 'Nothing lives here' || chr(10) || text WHEN doc_id % 19 = 0 THEN 'Welcome home' ELSE text END AS text, doc_id % 23 = 0 AS has_login, doc_id % 17 = 0 AS missing FROM documents),
        n AS (SELECT *, {_FOLD.format('text')} AS flat, {_NORMURL.format('requested')} AS want, {_NORMURL.format('final')} AS got FROM p),
        t AS (SELECT *, first_value(want) OVER (PARTITION BY flat ORDER BY at_) AS twin FROM n),
        v AS (SELECT *, CASE WHEN has_login THEN 'SKIPPED' WHEN missing THEN 'NOT_FOUND' WHEN got <> want OR flat = 'Welcome home' OR twin <> want THEN 'DUPLICATE' WHEN length(flat) < 200 THEN 'THIN' ELSE 'REAL' END AS result FROM t)
        SELECT requested, result, CASE WHEN result = 'DUPLICATE' THEN CASE WHEN got <> want THEN final WHEN flat = 'Welcome home' THEN 'home' ELSE twin END END AS duplicate_of FROM v""",
    "q_link_verdict": """WITH l AS (SELECT page_id AS i, 'https://example.org/f/' || page_id::VARCHAR || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' ELSE '' END AS link, CASE page_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' ELSE 'page' END AS kind,
          CASE WHEN page_id % 4 = 0 THEN 'text/html' WHEN page_id % 3 = 0 THEN 'application/pdf' WHEN page_id % 3 = 1 THEN 'image/png' ELSE 'text/html' END AS ctype, CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS status, (page_id * 37) % 400 AS len FROM pages),
        m AS (SELECT *, i % 7 = 0 OR i % 5 = 0 AS moved, CASE kind WHEN 'pdf' THEN contains(ctype, 'pdf') WHEN 'image' THEN starts_with(ctype, 'image/') ELSE true END AS ok FROM l)
        SELECT CASE WHEN kind <> 'page' AND (status >= 400 OR NOT ok) THEN 'DEAD' WHEN kind <> 'page' THEN CASE WHEN moved THEN 'REDIRECTED' ELSE 'WORKING' END WHEN i % 7 = 0 THEN 'REVIEW'
          WHEN status >= 400 THEN CASE WHEN len < 200 THEN 'DEAD' WHEN moved THEN 'REDIRECTED' ELSE 'REVIEW' END WHEN len < 200 THEN 'REVIEW' WHEN moved THEN 'REDIRECTED' ELSE 'WORKING' END AS verdict, kind, count(*) AS n FROM m GROUP BY ALL""",
    "q_old_links": f"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS t FROM pages),
        g AS (SELECT regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g') AS s FROM t),
        a AS (SELECT DISTINCT 'https://example.org/old/' || s || '-html' AS old FROM g),
        b AS (SELECT DISTINCT 'https://example.org/' || regexp_replace(s, '-[a-z]*-?$', '') AS new FROM g),
        wa AS (SELECT old, {_TOPIC.format('old')} AS w FROM a), wb AS (SELECT new, {_TOPIC.format('new')} AS w FROM b),
        s AS (SELECT old, new, round(len(list_intersect(wa.w, wb.w))::DOUBLE / len(list_distinct(list_concat(wa.w, wb.w))), 6) AS overlap FROM wa, wb WHERE list_has_any(wa.w, wb.w)),
        r AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY overlap DESC, length(new), new) AS r FROM s WHERE overlap >= 0.5)
        SELECT a.old, r.new, r.overlap FROM a LEFT JOIN r ON a.old = r.old AND r.r = 1""",
    "q_trim_history": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 4",
    "q_summary_cut": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n > 4 AND b > 2",
    "q_session_list": "SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn, substr(arg_min(text, turn), 1, 50) AS title FROM conversations GROUP BY conv_id",
    "q_followup": f"""WITH {TURNS}, w AS (SELECT *, trim(text) AS said, last_value(CASE WHEN role = 'user' AND trim(text) <> '' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM turns)
        SELECT conv_id, turn, CASE WHEN said <> '' AND length(said) <= 90 AND prev IS NOT NULL AND ({_LIKE('said', D.REFERENT)} OR {_LIKE('said', D.DEMONSTRATIVE)} OR {_LIKE('said', D.FRAGMENT)} OR (length(said) <= 30 AND {_LIKE('said', D.ANY_DEMONSTRATIVE)}))
          AND NOT contains(lower(said), lower(prev)) THEN said || ' (in the context of: ' || substr(prev, 1, 120) || ')' ELSE text END AS resolved FROM w WHERE role = 'user'""",
    "q_chitchat": f"""WITH {TURNS}, l AS (SELECT *, lower(trim(text)) AS low FROM turns)
        SELECT conv_id, turn, low = '' OR list_has_any(regexp_split_to_array(low, '\\s+'), {list((*D.GREETINGS, *D.FAREWELLS))!r}) OR {_OR(D.PARTS, 'low')} AS chitchat FROM l""",
    "q_route": f"""WITH {TURNS}, l AS (SELECT *, lower(text) AS low, regexp_replace(lower(text), 'e-?mail address', 'email', 'g') AS mail FROM turns), h AS (SELECT *, list_filter([{_FAMILY}], lambda x: x IS NOT NULL) AS hits FROM l)
        SELECT conv_id, turn, CASE WHEN {_OR(D.HIERARCHY, 'low')} THEN 'general' WHEN regexp_matches(low, '\\d+\\s*[-+*/]\\s*\\d+') OR (length(text) > 2 AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) < 0.5 * length(text)) THEN 'out_of_scope'
          WHEN {_OR(D.HARASSMENT, 'low')} OR regexp_matches(low, 're-?admission') THEN 'policy' WHEN {_OR(("tell me about", "tell about"), 'low')} AND NOT {_OR(("cricket", "flight", "weather", "world cup", "politics", "movie", "song"), 'low')} THEN 'faculty'
          WHEN len(hits) = 1 THEN hits[1] ELSE 'general' END AS route FROM h""",
    "q_session_ttl": """WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000, false)::INT AS g FROM events),
        s AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM g)
        SELECT user_id, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY ALL""",
    "q_incremental_upsert": f"WITH {SNAPS} SELECT source, status FROM verdicts",
    "q_status_counts": f"WITH {SNAPS} SELECT status, count(*) AS n FROM verdicts GROUP BY status",
    "q_upserted": f"""WITH {SNAPS} SELECT source, h AS page_hash FROM old WHERE source NOT IN (SELECT source FROM verdicts WHERE status IN ('added', 'updated'))
        UNION ALL SELECT source, h FROM verdicts WHERE status IN ('added', 'updated')""",
    "q_gap_cluster": f"WITH {CELLS} SELECT page_id, row_no, col_no, string_agg(text, ' ' ORDER BY x0, text) AS text FROM c2 GROUP BY ALL",
    "q_table_regions": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
        t AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM l WHERE length(line) > 60)
        SELECT doc_id AS page_id, min(pos)::BIGINT AS first_row, count(*) AS n_rows FROM t GROUP BY doc_id, i HAVING count(*) >= 3""",
    "q_metric_buckets": """WITH m AS (SELECT lang, CASE WHEN quality = 1 THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END + (n_chars % 50) / 100.0::DOUBLE AS m FROM labels JOIN documents USING (doc_id))
        SELECT lang, CASE WHEN m >= 0.75 THEN 'green' WHEN m >= 0.5 THEN 'amber' ELSE 'red' END AS bucket, count(*) AS n, round(avg(m), 6) AS mean FROM m GROUP BY ALL""",
    "q_label_counts": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "q_category_integrity": """WITH w AS (SELECT DISTINCT lang AS category FROM documents), r AS (SELECT unnest(['en', 'de', 'it']) AS category)
        SELECT category, 'not read' AS problem FROM w WHERE category NOT IN (SELECT category FROM r) UNION ALL SELECT category, 'not written' FROM r WHERE category NOT IN (SELECT category FROM w)""",
}

ROWS_ONLY = ("q_section_chunks", "q_parents_children", "q_communities", "q_table_text")
QUERIES = {name: globals()[name] for name in (*SQL, *ROWS_ONLY)}

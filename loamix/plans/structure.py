"""Queries over page trees, files, runs over a site and the routes of questions. What the tables lack is put in by rule, and so in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamix.operators import dom as D
from loamix.operators import routing as A
from loamix.operators import upkeep as K
from loamix.operators.pages import host
from loamix.plans import NORM, table
from loamix.plans.answering import _LISTS, _POPS
from loamix.plans.searching import BM25, bm25_rows, questions
from loamix.plans.serving import _OR, TURNS, turns

CARDS = (
    '<div><h3>Dr. A</h3><p>Lecturer</p><p>Department of X</p><a href="mailto:a@x.org">mail</a><button>Profile</button></div><div><h3>B</h3><p>Chairperson</p>'
    '<p>Department of X</p><a href="mailto:A@x.org">mail</a><a href="tel:12">call</a><button>Profile</button></div><div><h3>dr. a</h3><a href="mailto:a@x.org">m</a><button>Profile</button></div>'
)
CARD_WORDS = "Dr. A Lecturer Department of X mail Profile B Chairperson Department of X mail call Profile dr. a m Profile"
#: Address, and html before and after the text: trail and leftovers, landmarks, a contact page, a wide landmark, cards, bars and copies; then staff.
FORMS = (
    (
        "https://x.org/a", '<header>Site head</header><main id="main-content"><nav aria-label="Breadcrumb">Home</nav><p>',
        '</p><div><span>Image Unavailable</span></div><a href="/x">Back to list</a><p><a href="https://other.org/a b.pdf">Form</a></p></main>',
    ),
    ("https://x.org/b", "<nav>Menu</nav><article><h1>T</h1><p>", "</p></article><footer>foot</footer>"),
    ("https://x.org/contact", "<div>", "</div><footer>Call (824) 4100512</footer>"),
    ("https://x.org/c", "<aside>", "</aside><p>tail</p>"),
    ("https://x.org/d", '<main id="main-content"><p>', f"</p>{CARDS}</main>"),
    (
        "https://x.org/news/a", '<main id="main-content"><div><button>All Items</button><button>One</button><p>',
        "</p></div><div><h2>Related Official Notices</h2><p>other</p></div><div><button><b>1</b> Why?</button><p>Because</p></div><section data-faq><h3>Why?</h3><p>Because</p></section></main>",
    ),
)
REPLIES = (
    '{"entities": [{"name": "A", "type": "T", "description": "d"}, {"name": "B"}], "relationships": []}',
    'Here:\n```json\n{"entities": [], "relationships": [{"source": "A", "relation": "r", "target": "B"}]}\n```',
    "no json", '{"entities": [{"name": "A"', "{}",
)
STAFF = (
    '<div class="g"><div class="c"><h3>Mr. A</h3><p>Clerk</p><a href="mailto:a@x.org">m</a></div><div class="c"><h4>B C</h4><p>Helper</p></div><div class="c"><h3>mr. a</h3><p>Clerk</p></div></div>'
)
FORMS += (("https://x.org/offices/r", '<main id="main-content"><h1>Office R</h1><p>', f"</p>{STAFF}</main>"),)
PART_LEADS = ("attendance rule ", "who is the head ", "", "bus and fee ")
LEADS = ("list departments ", "latest news ", "", "how many students ")
PICKS = (("en", 3), ("de", 5), ("fr", 2))


def _of(values, key):
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")


def q_page_rules(spark, sf_dir):
    """The tree rules on every text, set in seven forms of page."""
    part = lambda i: _of([form[i] for form in FORMS], "doc_id")
    text = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pages = documents(spark, sf_dir).select("doc_id", part(0).alias("url"), F.concat(part(1), text, part(2)).alias("html"))
    found = D.page_content(pages, "doc_id")
    return found.select("doc_id", "main", "empty", F.array_join("dropped", ",").alias("dropped"), F.array_join("addresses", ",").alias("addresses"), F.array_join("lines", "\n").alias("text"))


def q_page_content(spark, sf_dir):
    found = D.page_content(table(spark, sf_dir, "pages"))
    return found.select("page_id", "main", "empty", F.array_join("addresses", ",").alias("addresses"), F.array_join("lines", "\n").alias("text"))


def lines(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def q_page_pieces(spark, sf_dir):
    top = F.col("pos") * 10
    blocks = lines(spark, sf_dir).select("doc_id", F.lit(0).alias("page_no"), F.lit(0).alias("x0"), F.lit(100).alias("x1"), top.alias("y0"), (top + 8).alias("y1"), "text")
    boxes = documents(spark, sf_dir).filter("doc_id % 2 = 0").selectExpr("doc_id", "0 AS page_no", "0 AS x0", "100 AS x1", "15 AS y0", "36 AS y1", "'| t |' AS text")
    return K.page_pieces(blocks, boxes).select("doc_id", "text")


def q_paragraph_runs(spark, sf_dir):
    style = F.when(F.col("pos") % 5 == 0, "Heading 1").when(F.col("pos") % 5 == 1, "Heading 2").otherwise("Normal")
    return K.paragraph_runs(lines(spark, sf_dir).withColumn("style", style))


def q_selection(spark, sf_dir):
    note = F.regexp_replace("text", "[\n\r]", " ")
    body = F.concat(F.lit("\n- https://x.org/"), F.col("doc_id").cast("string"), F.lit("\n- Note: "), note, F.lit("\n- PDF: a b.pdf\nplain\n- other\n## End\n- https://z.org"))
    title = F.when(F.col("doc_id") % 3 == 0, "## Others").otherwise("## Selection ")
    report = F.concat(F.lit("# Report\n- https://y.org\n"), title, body)
    rows = documents(spark, sf_dir).select("doc_id", K.selection(report).alias("s"))
    return rows.select("doc_id", *[F.array_join(f"s.{c}", "|").alias(c) for c in ("pages", "notes", "pdfs")])


def q_watched(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    reason = F.when(F.col("event_id") % 50 == 0, "unreachable").otherwise("ok")
    visits = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), start.alias("started"), (start + F.col("event_id") % 7).alias("ended"), reason.alias("reason"))
    return K.watched(visits, "user_id")


def q_page_result(spark, sf_dir):
    reason = F.when(F.col("doc_id") % 7 == 1, "dead").when(F.col("doc_id") % 7 > 1, "ok")
    return documents(spark, sf_dir).select("doc_id", K.page_result(reason, F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0).alias("result"))


def q_picked(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("address"), (F.col("page_id") % 4 == 0).alias("seen"))
    return K.picked(pages, [(name, n, F.contains("address", F.lit(f"/{name}/"))) for name, n in PICKS])


def q_extras(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return K.with_extras(pages.filter("page_id % 3 = 0"), pages)


def q_measured_or_kept(spark, sf_dir):
    docs = documents(spark, sf_dir)
    old, new = (docs.filter(f"doc_id % 2 = {i}").groupBy("lang").agg(F.count("*").alias("n")) for i in (0, 1))
    runs = [K.measured_or_kept(new, old, docs.agg(F.count("*").alias("n")), least).withColumn("least", F.lit(least)) for least in (1, 2_000_000_000)]
    return runs[0].unionByName(runs[1])


def q_merged_log(spark, sf_dir):
    log = lambda when, rule: table(spark, sf_dir, "pages").filter(rule).select("url", F.concat(F.lit(when), "page_id").alias("reason"))
    return K.merged_log(log("z old ", "page_id % 3 <> 0"), log("new ", "page_id % 2 = 0"))


def q_site_note(spark, sf_dir):
    facts = table(spark, sf_dir, "pages").select(
        host(F.col("url")).alias("site"), "page_id", F.lit(0).alias("pos"), (F.col("page_id") % 7 == 0).alias("on_home"), _of([k for k, _ in K.SECTIONS], "page_id").alias("kind"),
        _of(("Social", "Portal", None, "Rules", None), "page_id").alias("words"),
        F.expr(
            "CASE page_id % 5 WHEN 0 THEN concat('https://s.org/', page_id % 3) WHEN 1 THEN concat('https://p.org/', page_id % 2) WHEN 2 THEN CASE WHEN page_id % 2 = 0"
            " THEN concat(CASE WHEN page_id % 7 < 3 THEN 'Office' ELSE 'office' END, page_id % 4, '@x.org') ELSE concat('+12 345 678 901', page_id % 3) END"
            " WHEN 3 THEN concat('https://x.org/r', page_id % 4, '.pdf') ELSE concat('About us ', page_id % 2) END"
        ).alias("value"),
    )
    return K.site_note(facts, "University")


def q_questions(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").selectExpr(
        "CASE item_id % 3 WHEN 0 THEN concat('Q', item_id) WHEN 1 THEN concat('CAT ', item_id) END AS id", "CASE WHEN item_id % 2 = 0 THEN 'Fees' ELSE '' END AS category", "text AS question", "CASE WHEN item_id % 4 > 0 THEN text END AS answer"
    )
    return K.questions_of(rows, ("Q3",))


def q_requests(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", K.request_accepted(F.col("text"), F.expr("repeat('x', CAST(doc_id % 120 AS INT))")).alias("accepted"))


def q_campus_query(spark, sf_dir):
    rewrite = F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 1, F.concat(F.lit(" bus "), F.col("text"))).when(F.col("turn") % 4 == 2, " bus routes ")
    return turns(spark, sf_dir).select("conv_id", "turn", A.campus_query(F.col("text"), rewrite).alias("query"))


def q_retried(spark, sf_dir):
    rows = bm25_rows(spark, sf_dir).withColumn("score", F.col("score") - (F.col("query_id") % 3) * 1e6)
    return A.retried(questions(spark, sf_dir), rows, rows.filter("rank <= 3")).select("query_id", "doc_id", "rank")


def q_general_branch(spark, sf_dir):
    asked = F.concat(_of(LEADS, "turn"), F.col("text"))
    rows = turns(spark, sf_dir).select("conv_id", "turn", A.general_branch(asked).alias("b"))
    return rows.select("conv_id", "turn", F.array_join("b.branches", ",").alias("branches"), "b.search")


def q_part_agents(spark, sf_dir):
    asked = F.concat(_of(PART_LEADS, "turn"), F.col("text"))
    return turns(spark, sf_dir).select("conv_id", "turn", A.agent_of(asked).alias("agent"), A.searches_all(asked).alias("searches_all"))


def q_merged_parts(spark, sf_dir):
    rows = bm25_rows(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", F.col("text").alias("content")), "doc_id")
    return A.merged_parts(rows.select("query_id", (F.col("doc_id") % 3).alias("part"), "rank", F.col("doc_id").alias("chunk_id"), "content"))


def q_first_filled(spark, sf_dir):
    asked = questions(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("branches"))
    rows = bm25_rows(spark, sf_dir, 3).select("query_id", "doc_id")
    found = rows.filter("query_id % 2 = 0").withColumn("branch", F.lit("a")).unionByName(rows.withColumn("branch", F.lit("b")))
    return A.first_filled(asked, found)


def q_faculty_order(spark, sf_dir):
    rows = bm25_rows(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", F.col("text").alias("content")), "doc_id")
    rows = rows.select("query_id", F.col("doc_id").alias("chunk_id"), "rank", "content", F.col("score").alias("v"), F.when(F.col("query_id") % 2 == 1, F.col("score")).otherwise(1.0).alias("score"))
    return A.faculty_order(rows, F.col("v") - 8.0 * (F.col("chunk_id") % 3), F.col("chunk_id") % 4 == 0)


def q_from_sources(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "source")
    pages = docs.filter("doc_id % 97 = 0").select(F.concat(F.lit("https://x.org/"), F.col("source"), F.lit("/")).alias("url"))
    return A.from_sources(docs, pages)


def q_tool_search(spark, sf_dir):
    return A.tool_search(bm25_rows(spark, sf_dir), F.col("doc_id") % 2 == 0, 8, 3).select("query_id", "doc_id", "rank")


def q_answer_of(spark, sf_dir):
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" INTENT: x ANSWER: "), F.col("text"), F.lit(" ANSWER: y "))).when(F.col("doc_id") % 3 == 1, F.col("text")).otherwise("ANSWER:")
    return documents(spark, sf_dir).select("doc_id", A.answer_of(reply).alias("answer"))


def q_head_lines(spark, sf_dir):
    told = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, "mail a@b.org, or (c@d.org).")
    return documents(spark, sf_dir).select("doc_id", A.head_line(F.lit("P"), F.coalesce("lang", F.lit("?")), told).alias("line"))


def q_extraction(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.length(A.extraction_prompt(F.col("text"))).cast("bigint").alias("prompt_chars"), A.extraction_of(_of(REPLIES, "doc_id")).alias("x"))
    return rows.select("doc_id", "prompt_chars", *[F.size(f"x.{c}").cast("bigint").alias(f"n_{c}") for c in ("entities", "relationships")])


def q_unextracted(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id")
    return A.unextracted(docs, docs.filter("doc_id % 3 = 0"), "doc_id")


_BARE = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_DOCS = "d AS (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents)"
_LINES = f"{_DOCS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM d)"
_FOLDED = f"{_DOCS}, f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM d), g AS (SELECT doc_id, doc_id % 7 AS k, f, length(f) + (f <> '')::INT AS n FROM f)"
_NL = "array_to_string(list_filter([{0}], lambda x: x <> ''), chr(10))"
_KEEP = "[.,;()]+"
_AGENTS = " ".join(f"WHEN {_OR(words, 'low')} THEN '{agent}'" for agent, words in A.AGENTS.items())

SQL = {
    "q_page_rules": f"""WITH {_FOLDED}
        SELECT doc_id, CASE WHEN k IN (0, 4, 5, 6) THEN 'marked' WHEN k = 1 AND n + 1 > 100 THEN 'article' ELSE 'page' END AS main,
        CASE k WHEN 0 THEN n + {len("Image Unavailable Back to list Form")} < 150 WHEN 4 THEN n + {len(CARD_WORDS)} < 150 WHEN 5 THEN n + {len("All Items One Related Official Notices other 1 Why? Because Why? Because")} < 150 WHEN 6 THEN n + {len("Office R Mr. A Clerk m B C Helper mr. a Clerk")} < 150 ELSE false END AS empty,
        CASE k WHEN 0 THEN 'trail,placeholder,leftover' WHEN 5 THEN 'related,question,filter,filter' ELSE '' END AS dropped, CASE k WHEN 0 THEN 'https://other.org/a%20b.pdf' ELSE '' END AS addresses,
        CASE k WHEN 0 THEN {_NL.format("f, 'Form (https://other.org/a%20b.pdf)'")} WHEN 1 THEN {_NL.format("'# T', f")} WHEN 2 THEN {_NL.format("f, 'Call (824) 4100512'")}
          WHEN 3 THEN {_NL.format("CASE WHEN length(f) > 2000 THEN f ELSE '' END, 'tail'")}
          WHEN 4 THEN {_NL.format("f, 'Dr. A — Lecturer, Department of X. Email: a@x.org.', 'B — Chairperson, Department of X. Email not listed. Phone extension: 12.', 'B is the Head of the Department of X at the University.'")}
          WHEN 6 THEN {_NL.format("'# Office R', f, 'Mr. A — Clerk, Office R. Email: a@x.org.', 'B C — Helper, Office R. Email not listed.'")}
          ELSE {_NL.format("f, '# Why?', 'Because'")} END AS text FROM g""",
    "q_page_pieces": f"""WITH {_LINES}, p AS (SELECT doc_id, pos * 10 AS y, 0 AS late, {_BARE.format("text")} AS s FROM l WHERE doc_id % 2 = 1 OR pos * 10 + 4 NOT BETWEEN 15 AND 36 UNION ALL SELECT doc_id, 15, 1, '| t |' FROM d WHERE doc_id % 2 = 0)
        SELECT doc_id, string_agg(s, chr(10) ORDER BY y, late) AS text FROM p WHERE s <> '' GROUP BY doc_id""",
    "q_paragraph_runs": f"""WITH {_LINES}, p AS (SELECT doc_id, pos, pos % 5 < 2 AS head, {_BARE.format("text")} AS b FROM l),
        t AS (SELECT *, coalesce((head <> lag(head) OVER (PARTITION BY doc_id ORDER BY pos))::INT, 0) AS t FROM p WHERE b <> ''), r AS (SELECT *, sum(t) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM t),
        g AS (SELECT doc_id, run, head, list(CASE pos % 5 WHEN 0 THEN '# ' || b WHEN 1 THEN '## ' || b ELSE b END ORDER BY pos) AS ts FROM r GROUP BY ALL),
        c AS (SELECT doc_id, run, head, CASE WHEN head THEN [array_to_string(ts, chr(10))] ELSE list_transform(range(0, greatest(0, ceil((len(ts) - 3) / 2.0)::BIGINT * 2) + 1, 2), lambda i: array_to_string(list_slice(ts, i + 1, i + 3), ' ')) END AS cs FROM g),
        u AS (SELECT doc_id, run, head, unnest(cs) AS text, generate_subscripts(cs, 1) AS i FROM c)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run, i) AS chunk_no, CASE WHEN head THEN 'headings' ELSE 'prose' END AS kind, text FROM u""",
    "q_selection": f"""WITH {_DOCS}, n AS (SELECT doc_id, doc_id % 3 <> 0 AS has, regexp_replace(text, '[\\n\\r]', ' ', 'g') AS t FROM d)
        SELECT doc_id, CASE WHEN has THEN 'https://x.org/' || doc_id ELSE '' END AS pages, CASE WHEN has AND trim(t) <> '' THEN rtrim(t) ELSE '' END AS notes, CASE WHEN has THEN 'a b.pdf' ELSE '' END AS pdfs FROM n""",
    "q_watched": """WITH v AS (SELECT user_id, event_id AS seq, epoch_us(ts) AS s, epoch_us(ts) + event_id % 7 AS e FROM events), t AS (SELECT user_id, min(seq) AS stop FROM v WHERE seq % 50 = 0 GROUP BY ALL),
        r AS (SELECT v.*, coalesce(seq > stop, false) AS gone FROM v LEFT JOIN t USING (user_id)), g AS (SELECT *, s - lag(e) OVER (PARTITION BY user_id ORDER BY s, seq) AS gap FROM r WHERE NOT gone),
        a AS (SELECT user_id, count(*) AS n_fetched, min(gap) AS smallest_gap FROM g GROUP BY ALL)
        SELECT user_id, coalesce(any_value(n_fetched), 0) AS n_fetched, count_if(gone)::BIGINT AS n_left, any_value(smallest_gap) AS smallest_gap FROM r LEFT JOIN a USING (user_id) GROUP BY user_id""",
    "q_page_result": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'not_fetched' WHEN doc_id % 7 = 1 THEN 'dead' WHEN doc_id % 2 = 0 THEN 'ok' WHEN doc_id % 3 = 0 THEN 'not_cleaned' ELSE 'not_stored' END AS result FROM documents""",
    "q_picked": "WITH p AS (SELECT url AS address, bool_or(page_id % 4 = 0) AS seen FROM pages GROUP BY url), s AS (" + " UNION ALL ".join(f"(SELECT '{name}' AS slot, address, seen FROM p WHERE contains(address, '/{name}/') ORDER BY seen, address LIMIT {n})" for name, n in PICKS) + ") SELECT * FROM s",
    "q_extras": "SELECT u AS url, CASE WHEN bool_or(page_id % 3 = 0) THEN 'guaranteed' ELSE 'extra' END AS origin FROM (SELECT regexp_replace(url, '/+$', '') AS u, page_id FROM pages) WHERE u <> '' GROUP BY u",
    "q_measured_or_kept": "SELECT lang, count(*) AS n, CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 2000000000 END AS least FROM documents GROUP BY ALL",
    "q_merged_log": """WITH r AS (SELECT url, 0 AS age, 'z old ' || page_id AS reason FROM pages WHERE page_id % 3 <> 0 UNION ALL SELECT url, 1, 'new ' || page_id FROM pages WHERE page_id % 2 = 0)
        SELECT url, reason FROM r QUALIFY row_number() OVER (PARTITION BY url ORDER BY age DESC, reason DESC) = 1""",
    "q_site_note": """WITH v AS (SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS site, page_id, page_id % 7 <> 0 AS later, page_id % 5 + 1 AS section,
          CASE page_id % 5 WHEN 0 THEN 'https://s.org/' || page_id % 3 WHEN 1 THEN 'https://p.org/' || page_id % 2 WHEN 2 THEN CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 7 < 3 THEN 'Office' ELSE 'office' END || page_id % 4 || '@x.org' ELSE '+12 345 678 901' || page_id % 3 END
          WHEN 3 THEN 'https://x.org/r' || page_id % 4 || '.pdf' ELSE 'About us ' || page_id % 2 END AS value FROM pages),
        o AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY site, section, lower(value) ORDER BY later, page_id) = 1),
        n AS (SELECT site, section, string_agg(CASE section WHEN 1 THEN 'Social: ' WHEN 2 THEN 'Portal: ' WHEN 3 THEN CASE WHEN contains(value, '@') THEN 'Email: ' ELSE 'Phone: ' END WHEN 4 THEN 'Rules: ' ELSE '' END || value, chr(10) ORDER BY later, page_id) AS t FROM o GROUP BY ALL)
        SELECT site, 'University — official links and contacts' || chr(10) || string_agg(['Official social media pages', 'Portals and services', 'Contact', 'Rules, policies and forms', 'About the university'][section] || ':' || chr(10) || t, chr(10) || chr(10) ORDER BY section) AS note FROM n GROUP BY site""",
    "q_questions": "SELECT 'Q' || item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'Fees' ELSE 'Unknown' END AS category, trim(text) AS question, trim(text) AS answer FROM benchmark WHERE item_id % 3 = 0 AND item_id <> 3 AND item_id % 4 > 0 AND text <> ''",
    "q_requests": f"WITH {_DOCS} SELECT doc_id, length(text) BETWEEN 1 AND 2000 AND doc_id % 120 BETWEEN 1 AND 100 AS accepted FROM d",
    "q_campus_query": f"""WITH {TURNS}, r AS (SELECT *, {_BARE.format("CASE turn % 4 WHEN 1 THEN ' bus ' || text WHEN 2 THEN 'bus routes' ELSE '' END")} AS w FROM turns)
        SELECT conv_id, turn, CASE WHEN {_OR(A.PLACE_WORDS, 'lower(text)')} OR w = '' OR len(regexp_split_to_array(w, '\\s+')) > 12 THEN text ELSE w END AS query FROM r""",
    "q_retried": f"WITH {BM25} SELECT query_id, doc_id, rank FROM best WHERE rank <= CASE WHEN query_id % 3 = 0 THEN 10 ELSE 3 END",
    "q_general_branch": f"""WITH {TURNS}, a AS (SELECT conv_id, turn, list_extract({list(LEADS)!r}, (turn % 4 + 1)::BIGINT) || text AS q FROM turns), l AS (SELECT *, lower(q) AS low FROM a)
        SELECT conv_id, turn, concat(CASE WHEN {_OR(A.A.COUNT_WORDS, 'low')} AND NOT ({_LISTS}) AND len(list_filter([{_POPS}], lambda x: x IS NOT NULL)) > 0 THEN 'populations,' END, CASE WHEN {_OR(A.COUNT_DEPARTMENTS, 'low')} THEN 'departments,' END,
          CASE WHEN {_OR(A.LIST_DEPARTMENTS, 'low')} THEN 'department list,' END, 'search') AS branches, CASE WHEN {_OR(A.NEWS_WORDS, 'low')} THEN '{A.NEWS_QUERY}' ELSE q END AS search FROM l""",
    "q_part_agents": f"""WITH {TURNS}, l AS (SELECT conv_id, turn, lower(list_extract({list(PART_LEADS)!r}, (turn % 4 + 1)::BIGINT) || text) AS low FROM turns)
        SELECT conv_id, turn, CASE {_AGENTS} ELSE 'general' END AS agent, {_OR(A.ATTENDANCE, 'low')} AND NOT {_OR(A.OTHER_RULES, 'low')} AS searches_all FROM l""",
    "q_merged_parts": f"""WITH {BM25}, l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {NORM.format('x')}), lambda x: x <> '') AS key FROM documents),
        r AS (SELECT query_id, doc_id, doc_id % 3 AS part, rank, row_number() OVER (PARTITION BY query_id, key ORDER BY doc_id % 3, rank, doc_id) AS copy FROM best JOIN l USING (doc_id) WHERE rank <= 10)
        SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY part, rank, doc_id) AS new_rank FROM r WHERE copy = 1""",
    "q_first_filled": f"WITH {BM25} SELECT query_id, doc_id, CASE WHEN query_id % 6 = 0 THEN 'a' ELSE 'b' END AS branch FROM best WHERE rank <= 3",
    "q_faculty_order": f"""WITH {BM25}, r AS (SELECT query_id, doc_id, rank, score AS v, doc_id % 4 = 0 AS f, CASE WHEN query_id % 2 = 1 THEN score ELSE 1 END AS s, row_number() OVER (PARTITION BY query_id, coalesce(text, '') ORDER BY rank, doc_id) AS copy FROM best JOIN documents USING (doc_id) WHERE rank <= 10),
        t AS (SELECT query_id, count(*) AS n, count(DISTINCT s) AS ss, count_if(f) AS late FROM r WHERE copy = 1 GROUP BY ALL), o AS (SELECT *, ss <= 1 AND n BETWEEN 2 AND 10 AS mute FROM r JOIN t USING (query_id) WHERE copy = 1)
        SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN mute THEN -round(v - 8.0::DOUBLE * (doc_id % 3), 6) ELSE (late > 0 AND late < n AND f)::INT::DOUBLE END, CASE WHEN NOT mute THEN rank END, doc_id) AS new_rank FROM o""",
    "q_from_sources": "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE doc_id % 97 = 0)",
    "q_tool_search": f"WITH {BM25} SELECT query_id, doc_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM best WHERE rank <= 8 AND doc_id % 2 = 0) WHERE r <= 3",
    "q_answer_of": f"WITH {_DOCS} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_BARE.format(chr(39) * 2 + ' || text || ' + chr(39) + ' ANSWER: y ' + chr(39))} WHEN 1 THEN {_BARE.format('text')} ELSE '' END AS answer FROM d",
    "q_head_lines": f"""WITH {_DOCS}, m AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: contains(w, '@')) AS ms FROM d), n AS (SELECT *, regexp_replace(ms[-1], '^{_KEEP}|{_KEEP}$', '', 'g') AS mail FROM m)
        SELECT doc_id, '• ' || coalesce(lang, '?') || ': P' || CASE doc_id % 3 WHEN 0 THEN CASE WHEN coalesce(mail, '') <> '' THEN ' — ' || mail WHEN text <> '' THEN ' — ' || substr(text, 1, 60) ELSE '' END WHEN 1 THEN ' — c@d.org' ELSE '' END AS line FROM n""",
    "q_extraction": f"WITH {_DOCS} SELECT doc_id, CASE WHEN length({_BARE.format('text')}) >= 50 THEN least(length(text), 2000) END AS prompt_chars, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END::BIGINT AS n_entities, CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END::BIGINT AS n_relationships FROM d",
    "q_unextracted": "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0",
}
ROWS_ONLY = ("q_page_content",)
QUERIES = {name: globals()[name] for name in (*SQL, *ROWS_ONLY)}

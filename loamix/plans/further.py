"""Page text, links, query rewriting and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamix.functions import text as T
from loamix.functions import urls as U
from loamix.operators import agents as A
from loamix.operators import dialogue as D
from loamix.operators import html as H
from loamix.operators import retrieval as R
from loamix.operators.html import running_lines
from loamix.plans import table
from loamix.sources import readers

STOP = ["the", "and", "for", "with", "that", "this", "are", "was", "from", "les", "des", "que", "der", "die", "und", "los", "las"]
EXPANSIONS = (("the", "article definite"), ("the the", "repeated article"), ("que", "that which"), ("der", "masculine article"), ("ción", "noun ending action"))


def q_html_text(spark, sf_dir):
    out = H.page_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_running_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("University of Example\n"), F.col("text"), F.lit("\nPage "), F.col("doc_id").cast("string"))
    pages = docs.select((F.col("doc_id") % 40).alias("pdf"), F.col("doc_id").alias("page_no"), text.alias("text"))
    out = running_lines(pages, "pdf", "page_no", "text")
    return out.select("pdf", "page_no", F.contains("text", F.lit("University of Example")).alias("has_header"), F.length("text").alias("n_chars"))


def q_link_kinds(spark, sf_dir):
    """Links of pages by kind, and the first of each platform."""
    pages = table(spark, sf_dir, "pages")
    i = F.col("page_id").cast("string")
    own = F.array(F.concat(F.lit("https://facebook.com/p"), i), F.lit("mailto:a@b.org"), F.lit("tel:+12345"), F.concat(F.lit("https://x.org/f"), i, F.lit(".pdf")), F.lit("https://portal.example.org/login"))
    rows = pages.select("page_id", F.explode(F.concat(U.links(F.col("html")), own)).alias("href"))
    kind = (
        F.when(F.col("href").rlike("^(mailto|tel):"), "contact").when(F.col("href").rlike("(?i)//(www\\.)?(facebook|twitter|youtube|linkedin|instagram)\\.com"), "social")
        .when(F.col("href").rlike(r"(?i)\.pdf($|[?#])"), "pdf").when(F.contains("href", F.lit("portal")), "portal").when(F.col("href").startswith("/"), "page").otherwise("other")
    )
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("href").alias("n_distinct"), F.min("href").alias("first_href"))


def q_page_directory(spark, sf_dir):
    """One text per section: title and address of its pages, sorted and distinct."""
    pages = table(spark, sf_dir, "pages").select(U.section(F.col("url")).alias("section"), F.concat(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(" — "), F.col("url")).alias("line"))
    lines = pages.distinct().groupBy("section").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return lines.select("section", F.size("lines").cast("bigint").alias("n"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("text_md5"))


def q_query_expansion(spark, sf_dir):
    """The longest key that a passage contains gives further terms."""
    keys = spark.createDataFrame(EXPANSIONS, "key string, terms string")
    return A.expanded(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), keys)


def q_content_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = R.content_words(F.col("text"), STOP)
    return docs.select("doc_id", F.size(words).cast("bigint").alias("n_words"), F.array_join(F.slice(words, 1, 3), " ").alias("first"))


def q_sub_questions(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.concat(F.lit("what is "), F.col("text"), F.lit(", and who is the registrar; where & why")).alias("text"))
    parts = asked.select("conv_id", "turn", F.posexplode(D.sub_questions(F.col("text"))).alias("part", "question"))
    return parts.select("conv_id", "turn", F.col("part").cast("bigint").alias("part"), "question")


def q_phrase_recovery(spark, sf_dir):
    """Documents that hold a phrase in either casing, shortest first."""
    return A.with_phrase(table(spark, sf_dir, "documents"), "the the")


ROLES = ("Dr. A Khan is the Registrar", "The Registrar met Mr. B Ali", "The Registrar's office", "Mrs. C serves as our Deputy Registrar", "Registry")


def q_role_tiers(spark, sf_dir):
    """Lines that say who holds a post, name a person beside it, or only name it; the best tier first."""
    told = F.get(F.array(*[F.lit(r) for r in ROLES]), (F.col("doc_id") % len(ROLES)).cast("int"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.concat("text", F.lit("\n"), told), "\n")).alias("line"))
    docs = lines.groupBy("doc_id").agg(F.min(A.role_tier(F.col("line"), "Registrar")).alias("tier"))
    return docs.filter("tier is not null").select("doc_id", F.col("tier").cast("bigint").alias("tier"))


def q_role_holders(spark, sf_dir):
    told = F.get(F.array(*[F.lit(r) for r in ROLES]), (F.col("doc_id") % len(ROLES)).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(told, F.lit(". "), "text").alias("text"))
    return A.role_holders(docs, ["Registrar", "Registry"]).select("doc_id", F.col("tier").cast("bigint").alias("tier"), "rank")


def q_source_lookup(spark, sf_dir):
    """Rows of an address with or without a slash at its end: the form that has rows, the plain one first."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("url"), F.when(F.col("page_id") % 2 == 0, "/").otherwise("")).alias("source"))
    asked = table(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("wanted"))
    hits = pages.join(asked, F.regexp_replace("source", "/+$", "") == F.regexp_replace("wanted", "/+$", ""))
    slashed = F.endswith("source", F.lit("/"))
    first = F.min(slashed).over(Window.partitionBy("query_id"))
    return hits.withColumn("slashed", slashed).withColumn("first", first).filter("slashed = first").select("query_id", "page_id", "slashed")


def q_mentions(spark, sf_dir):
    """Addresses that lines mention, by kind."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.concat("text", F.lit("\nsee https://a.org/x, b@c.org or d.edu. "), F.col("source")), "\n")).alias("line"))
    found = lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"https?://[^\s,;)]+|[\w.-]+@[\w.-]+\.\w+|\b[a-z0-9-]+\.(?:edu|org|com|net)\b"), F.lit(0))).alias("m"))
    kind = F.when(F.contains("m", F.lit("@")), "mail").when(F.col("m").startswith("http"), "link").otherwise("domain")
    return found.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("m").alias("n_distinct"))


def q_sitemap(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 9).alias("part")).agg(F.array_sort(F.collect_list("url")).alias("urls"))
    entries = F.array_join(F.transform("urls", lambda u: F.concat(F.lit("<url><loc> "), F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))), "")
    xml = pages.select(F.concat(F.when(F.col("part") == 0, "<sitemapindex>").otherwise("<urlset>"), entries).alias("xml"))
    return readers.sitemap_urls(xml).groupBy("kind").agg(F.count("*").alias("n"), F.min("address").alias("first_address"))


def q_first_per_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("doc_id"), F.count("*").alias("n"), F.median("n_chars").alias("mid_chars"))


def q_content_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha1(T.content_key(F.col("text")).cast("binary")).alias("twin"), T.content_hash(F.col("text")).alias("content_hash"), F.sha1(T.proposition_key(F.col("text")).cast("binary")).alias("prop"))


_STOPS = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_ROLE = "list_extract([" + ", ".join("'" + r.replace("'", "''") + "'" for r in ROLES) + f"], (doc_id % {len(ROLES)} + 1)::BIGINT)"
_SECTION = "coalesce(list_filter(string_split('/' || regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[#?].*$', ''), '^(?:https?:)?//[^/]*', ''), '^/+|/+$', '', 'g'), '/'), lambda s: s <> '')[1], '(home)')"

SQL = {
    "q_link_kinds": r"""WITH l AS (SELECT unnest(list_concat(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1),
          ['https://facebook.com/p' || page_id::VARCHAR, 'mailto:a@b.org', 'tel:+12345', 'https://x.org/f' || page_id::VARCHAR || '.pdf', 'https://portal.example.org/login'])) AS href FROM pages)
        SELECT CASE WHEN regexp_matches(href, '^(mailto|tel):') THEN 'contact' WHEN regexp_matches(href, '(?i)//(www\.)?(facebook|twitter|youtube|linkedin|instagram)\.com') THEN 'social'
          WHEN regexp_matches(href, '(?i)\.pdf($|[?#])') THEN 'pdf' WHEN contains(href, 'portal') THEN 'portal' WHEN starts_with(href, '/') THEN 'page' ELSE 'other' END AS kind,
          count(*) AS n, count(DISTINCT href) AS n_distinct, min(href) AS first_href FROM l GROUP BY ALL""",
    "q_page_directory": f"""WITH l AS (SELECT DISTINCT {_SECTION} AS section, regexp_extract(html, '<title>([^<]*)', 1) || ' — ' || url AS line FROM pages)
        SELECT section, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY line)) AS text_md5 FROM l GROUP BY section""",
    "q_query_expansion": f"""WITH k AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{t}')" for k, t in EXPANSIONS)}) v(key, terms)),
        h AS (SELECT item_id, key, terms, row_number() OVER (PARTITION BY item_id ORDER BY length(key) DESC, key DESC) AS r FROM benchmark JOIN k ON contains(lower(text), key))
        SELECT b.item_id AS query_id, h.key, coalesce(h.terms, '') AS added FROM benchmark b LEFT JOIN h ON b.item_id = h.item_id AND r = 1""",
    "q_content_words": f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains({_STOPS}, x)) AS w FROM documents),
        f AS (SELECT doc_id, w, list_filter(w, lambda x, i: list_position(w, x) = i) AS d FROM w)
        SELECT doc_id, len(d)::BIGINT AS n_words, array_to_string(d[1:3], ' ') AS first FROM f""",
    "q_sub_questions": rf"""WITH a AS (SELECT conv_id, turn, 'what is ' || text || ', and who is the registrar; where & why' AS t FROM conversations WHERE role = 'user'),
        p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(t, '{D.INTENT_CUT}'), lambda x: regexp_replace(x, '^[ ?.,]+|[ ?.,]+$', '', 'g')), lambda x: x <> '') AS p FROM a),
        r AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS i, unnest(p) AS part FROM p),
        q AS (SELECT *, nullif(regexp_extract(part, '{D.QUESTION}', 1), '') AS own FROM r),
        l AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i), 'what is') AS led FROM q),
        e AS (SELECT conv_id, turn, i, CASE WHEN own IS NULL THEN led || ' ' || part ELSE part END AS question FROM l),
        k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS part, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM e
              WHERE len(list_filter(regexp_extract_all(lower(question), '[a-z0-9'']+'), lambda w: length(w) > 1 AND NOT list_contains({list(D.INTENT_STOP)!r}, w))) >= 1)
        SELECT conv_id, turn, part, question FROM k WHERE n > 1""",
    "q_phrase_recovery": "SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE contains(text, 'the the') OR contains(text, 'The the') ORDER BY n, doc_id LIMIT 12",
    "q_role_tiers": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || {_ROLE}, chr(10))) AS line FROM documents)
        SELECT doc_id, min(CASE WHEN regexp_matches(regexp_extract(line, '(?s)({A.PERSON}.*)$', 1), '{A.ASSERTS}[^.]{{0,40}}Registrar') THEN 0 WHEN regexp_matches(line, '{A.PERSON}') THEN 1 ELSE 2 END)::BIGINT AS tier
        FROM l WHERE contains(line, 'Registrar') GROUP BY doc_id""",
    "q_role_holders": rf"""WITH d AS (SELECT doc_id, {_ROLE} || '. ' || text AS t FROM documents),
        h AS (SELECT doc_id, CASE WHEN regexp_matches(regexp_extract(t, '(?s)({A.PERSON}.*)$', 1), '{A.ASSERTS}[^.]{{0,40}}Registrar') THEN 0 WHEN regexp_matches(t, '{A.PERSON}') THEN 1 ELSE 2 END::BIGINT AS tier FROM d WHERE contains(t, 'Registrar'))
        SELECT * FROM (SELECT doc_id, tier, row_number() OVER (ORDER BY tier, doc_id) AS rank FROM h) WHERE rank <= 6""",
    "q_source_lookup": r"""WITH p AS (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END AS source FROM pages), a AS (SELECT page_id AS query_id, url AS wanted FROM pages),
        h AS (SELECT query_id, page_id, ends_with(source, '/') AS slashed FROM p JOIN a ON regexp_replace(source, '/+$', '') = regexp_replace(wanted, '/+$', ''))
        SELECT query_id, page_id, slashed FROM (SELECT *, min(slashed) OVER (PARTITION BY query_id) AS f FROM h) WHERE slashed = f""",
    "q_mentions": r"""WITH l AS (SELECT unnest(string_split(text || chr(10) || 'see https://a.org/x, b@c.org or d.edu. ' || source, chr(10))) AS line FROM documents),
        m AS (SELECT unnest(regexp_extract_all(line, 'https?://[^\s,;)]+|[\w.-]+@[\w.-]+\.\w+|\b[a-z0-9-]+\.(?:edu|org|com|net)\b')) AS m FROM l)
        SELECT CASE WHEN contains(m, '@') THEN 'mail' WHEN starts_with(m, 'http') THEN 'link' ELSE 'domain' END AS kind, count(*) AS n, count(DISTINCT m) AS n_distinct FROM m GROUP BY ALL""",
    "q_sitemap": """WITH p AS (SELECT page_id % 9 AS part, replace(url, '&', '&amp;') AS u FROM pages)
        SELECT CASE WHEN part = 0 THEN 'index' ELSE 'page' END AS kind, count(*) AS n, min(u) AS first_address FROM (SELECT DISTINCT part, u FROM p) GROUP BY 1""",
    "q_first_per_source": "SELECT source, first(doc_id ORDER BY n_chars, doc_id) AS doc_id, count(*) AS n, median(n_chars) AS mid_chars FROM documents GROUP BY source",
    "q_content_keys": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        k AS (SELECT doc_id, i, trim(regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '^[#•|\s]+', '')) AS k FROM l),
        g AS (SELECT doc_id, coalesce(string_agg(k, chr(10) ORDER BY i) FILTER (WHERE k <> ''), '') AS t FROM k GROUP BY doc_id)
        SELECT doc_id, sha1(g.t) AS twin, substr(md5(text), 1, 8) AS content_hash, sha1(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS prop FROM documents JOIN g USING (doc_id)""",
}
ROWS_ONLY = ("q_html_text", "q_running_lines")
QUERIES = {name: globals()[name] for name in (*SQL, *ROWS_ONLY)}

"""Metadata, quality gates and URL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamix.functions import text as T
from loamix.functions import urls as U
from loamix.operators import metadata as M
from loamix.plans import BARE, table

SLUGS = ("about/leadership", "academics/departments/computer-science", "offices/registrar", "faculty-members", "admissions-open", "fee-structure", "news/2021", "research/oric/grants", "conduct-rules", "tag/news", "contact")


def chunks(spark, sf_dir):
    """Documents as chunks with sources, headings and dates put in by rule, as the tables hold none."""
    docs = table(spark, sf_dir, "documents")
    slug = F.get(F.array(*[F.lit(s) for s in SLUGS]), (F.col("doc_id") % len(SLUGS)).cast("int"))
    source = F.concat(F.lit("https://www.example.org/"), slug, F.lit("/"))
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## Part "), F.col("doc_id").cast("string"), F.lit("\n"))).when(F.col("doc_id") % 3 == 1, F.lit("[Rules — continued]\n")).otherwise("")
    tail = F.when(F.col("doc_id") % 4 == 0, F.lit("\nNotified on 15th January 2019 by the Dean.")).when(F.col("doc_id") % 4 == 1, F.lit("\nRevised 2023")).otherwise("")
    return docs.select("doc_id", source.alias("src"), F.concat(head, F.col("text"), tail).alias("body"))


CHUNKS = f"""chunks AS (SELECT doc_id, 'https://www.example.org/' || list_extract({list(SLUGS)!r}, (doc_id % {len(SLUGS)} + 1)::BIGINT) || '/' AS src,
  CASE WHEN doc_id % 3 = 0 THEN '## Part ' || doc_id::VARCHAR || chr(10) WHEN doc_id % 3 = 1 THEN '[Rules — continued]' || chr(10) ELSE '' END || text ||
  CASE WHEN doc_id % 4 = 0 THEN chr(10) || 'Notified on 15th January 2019 by the Dean.' WHEN doc_id % 4 = 1 THEN chr(10) || 'Revised 2023' ELSE '' END AS body FROM documents),
paths AS (SELECT *, '/' || regexp_replace(regexp_replace(regexp_replace(lower(trim(src)), '[#?].*$', ''), '^(?:https?:)?//[^/]*', ''), '^/+|/+$', '', 'g') AS p FROM chunks),
segs AS (SELECT *, list_filter(string_split(p, '/'), lambda s: s <> '') AS g FROM paths),
told AS (SELECT *, coalesce(g[1], '') AS s1, coalesce(g[2], '') AS s2, coalesce(g[-1], '') AS sl, list_filter(regexp_split_to_array(coalesce(g[1], ''), '[-_.]+'), lambda s: s <> '') AS t1,
  list_filter(regexp_split_to_array(coalesce(g[-1], ''), '[-_.]+'), lambda s: s <> '') AS tl FROM segs)"""


def _in(words, c):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


CATEGORY = f"""CASE WHEN list_has_any(g, {_list(U.EXCLUDED)}) OR (len(g) >= 2 AND coalesce(g[-2], '') = 'page' AND regexp_matches(sl, '^[0-9]+$')) THEN NULL
  WHEN len(g) = 0 THEN 'general' WHEN list_has_any(t1, {_list(U.CONTACT_TOKENS)}) OR list_has_any(tl, {_list(U.CONTACT_TOKENS)}) THEN 'general'
  WHEN s1 = 'academics' AND s2 IN ('departments', 'faculty') THEN 'faculty' WHEN s1 = 'academics' AND s2 IN ('programs', 'undergraduate', 'graduate') THEN 'admissions'
  WHEN s1 = 'research' AND s2 = 'oric' THEN 'offices' WHEN s1 = 'faculty' OR (starts_with(s1, 'faculty') AND len(t1) <= 3) THEN 'faculty'
  WHEN list_contains(t1, 'department') AND len(t1) <= 3 THEN 'faculty' WHEN regexp_matches(s1, '^(office|directorate)') AND len(t1) <= 5 THEN 'offices'
  WHEN list_has_any(t1, {_list(U.ADMISSION_TOKENS)}) THEN 'admissions' WHEN regexp_matches(s1, '^(undergraduate|graduate|postgraduate|program|fee|prospectus)') AND len(t1) <= 3 THEN 'admissions'
  WHEN list_has_any(t1, {_list(U.POLICY_TOKENS)}) OR list_has_any(tl, {_list(U.POLICY_TOKENS)}) THEN 'policy'
  WHEN s1 = 'about' OR (starts_with(s1, 'about') AND len(t1) <= 3) THEN 'overview' WHEN ends_with(s1, '-message') AND len(t1) <= 3 THEN 'overview' ELSE 'general' END"""


def q_metadata(spark, sf_dir):
    body = F.col("body")
    return M.build(chunks(spark, sf_dir), F.col("src"), U.category(F.col("src")), F.lit("web"), body, T.content_hash(T.strip_image_blocks(body)), "doc_id").drop("page_hash")


def q_url_category(spark, sf_dir):
    rows = chunks(spark, sf_dir).groupBy("src").agg(F.count("*").alias("n"))
    return rows.select("src", U.category(F.col("src")).alias("category"), U.department(F.col("src")).alias("department"), "n")


def q_url_normalise(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.normalised(url).alias("normal"), U.path(url).alias("path"), U.section(url).alias("section"), U.kind(url).alias("kind"), U.is_contact_page(url).alias("contact"))


def q_section_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.section(F.col("url")).alias("section")).agg(F.count("*").alias("n"))


def q_quality_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 10 / 10.0 + 0.2).alias("conf"), (F.col("doc_id") % 5 == 0).alias("is_table"))
    s = T.ocr_signals(F.col("text"))
    return docs.select("doc_id", s["length"].alias("length"), F.round(s["letterish"], 6).alias("letterish"), F.round(s["wordish"], 6).alias("wordish"), M.gate(F.col("text"), F.col("conf"), F.col("is_table")).alias("reason"))


def q_function_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.round(T.function_word_share(F.col("text"), list(M.FUNCTION_WORDS)), 6).alias("share"))


def q_gazette(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Results ....... 12\n3rd Semester\n"), F.col("text"))).otherwise(F.col("text"))
    return docs.select("doc_id", M.is_gazette(text).alias("rejected"))


def q_toc_headings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("Contents ...... 3\n| a ....... 4\nCHAPTER I\n1.2 Scope of rules\n2 Not this,\n"), F.col("text"))
    done = T.headings_marked(T.toc_lines_stripped(text), F.lit("Rules"))
    return docs.select("doc_id", F.md5(done.cast("binary")).alias("text_md5"))


def q_labels(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.groupBy("doc_id").agg(F.count_if(T.is_navigation_label(F.col("line"))).alias("n_labels"), F.count("*").alias("n_lines"))


def q_page_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(U.links(F.col("html"))).alias("href"))
    return pages.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct("href").alias("n_distinct"), F.min("href").alias("first_href"))


def q_pdf_discovery(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    i = F.col("page_id").cast("string")
    html = F.concat(F.col("html"), F.lit('<a href="/files/rules-'), i, F.lit('.pdf#page=2">x</a><a href="/files/rules-'), i, F.lit('.pdf">x</a><a href=\'/a/prospectus.PDF?v=1\'>x</a>'))
    return pages.select("page_id", F.explode(U.pdf_links(html)).alias("pdf"))


def q_pdf_referrers(spark, sf_dir):
    """For each PDF its pages, and the category of the first page in order that isn't general."""
    pages = table(spark, sf_dir, "pages").select("page_id", U.section(F.col("url")).alias("category"), F.concat(F.lit("/files/rules-"), (F.col("page_id") % 20).cast("string"), F.lit(".pdf")).alias("pdf"))
    best = F.coalesce(F.min(F.when(F.col("category") != "en", F.col("category"))), F.lit("en"))
    return pages.groupBy("pdf").agg(F.count("*").alias("n_pages"), best.alias("category"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def q_proposition_parse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    reply = F.concat(F.lit("1. "), F.regexp_replace("text", "\n", "\n12) "), F.lit("\n3. short"))
    return docs.select("doc_id", F.posexplode(T.propositions_of(reply)).alias("prop_index", "text")).select("doc_id", F.col("prop_index").cast("bigint").alias("prop_index"), F.sha1(F.col("text").cast("binary")).alias("fingerprint"))


_TITLES = "(" + " OR ".join(f"contains(lower(body), '{t}')" for t in T.TITLES) + ")"
_FW = "[" + ", ".join(f"'{w}'" for w in M.FUNCTION_WORDS) + "]"
_SHARE = f"CASE WHEN len(w) > 0 THEN 100.0::DOUBLE * len(list_filter(w, lambda x: list_contains({_FW}, x))) / len(w) ELSE 0 END"

SQL = {
    "q_metadata": rf"""WITH {CHUNKS}, c AS (SELECT *, {CATEGORY} AS category, lower(src) AS low, trim(string_split(trim(body), chr(10))[1]) AS f FROM told)
        SELECT doc_id, src AS source, 'web' AS source_type, category,
          CASE WHEN len(g) >= 3 AND s1 = 'academics' AND s2 = 'departments' THEN g[3] WHEN regexp_matches(low, 'rule|policy|conduct|disciplinary|anti-drug') THEN 'all' ELSE 'general' END AS department,
          CASE WHEN contains(low, '/#site-info-') THEN 'site_info' WHEN contains(low, '/#pages-') THEN 'page_directory'
            WHEN s1 = 'about' AND len(g) = 2 AND (ends_with(s2, '-message') OR s2 = 'leadership') THEN 'leadership_message'
            WHEN s1 = 'offices' OR (s1 = 'research' AND s2 = 'oric') THEN 'office_info' WHEN s1 = 'academics' AND s2 IN ('faculty', 'departments') THEN 'faculty_page'
            WHEN {_in(M.LEADERSHIP, 'low')} THEN 'leadership_message' WHEN contains(low, 'faculty') THEN 'faculty_page' WHEN {_in(M.POLICY, 'low')} THEN 'policy_document'
            WHEN contains(low, 'admission') THEN 'admission_info' WHEN contains(low, 'fee') THEN 'fee_structure' WHEN {_in(M.OFFICES, 'low')} THEN 'office_info'
            WHEN category = 'overview' OR {_in(M.OVERVIEW, 'low')} THEN 'overview_page' ELSE 'general_page' END AS content_type,
          CASE WHEN regexp_extract(f, '^#{{1,4}}\s+(.+)$', 1) <> '' THEN trim(regexp_extract(f, '^#{{1,4}}\s+(.+)$', 1))
            WHEN regexp_extract(f, '^\[(.+?)(?:\s*—\s*continued)?\]$', 1) <> '' THEN trim(regexp_extract(f, '^\[(.+?)(?:\s*—\s*continued)?\]$', 1)) ELSE 'unknown' END AS section,
          {_TITLES} OR regexp_matches(body, '(?:^|[^\p{{L}}\p{{N}}_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+(?:$|[^\p{{L}}\p{{N}}_])') AS contains_person,
          CASE WHEN regexp_extract(body, '{T.FULL_DATE}', 1) <> '' THEN regexp_extract(body, '{T.FULL_DATE}', 1)::INT
            WHEN regexp_extract(body, '{T.YEAR}', 1) <> '' THEN regexp_extract(body, '{T.YEAR}', 1)::INT END AS doc_year,
          substr(md5(body), 1, 8) AS content_hash, length(body)::BIGINT AS char_count FROM c""",
    "q_url_category": rf"""WITH {CHUNKS} SELECT src, {CATEGORY} AS category,
          CASE WHEN len(g) >= 3 AND s1 = 'academics' AND s2 = 'departments' THEN g[3] WHEN regexp_matches(lower(src), 'rule|policy|conduct|disciplinary|anti-drug') THEN 'all' ELSE 'general' END AS department,
          count(*) AS n FROM told GROUP BY ALL""",
    "q_url_normalise": r"""WITH p AS (SELECT page_id, url, '/' || regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[#?].*$', ''), '^(?:https?:)?//[^/]*', ''), '^/+|/+$', '', 'g') AS path FROM pages)
        SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)http://', 'https://'), '^https://(?i)www\.', 'https://'), '/+$', '') AS normal, path,
          coalesce(list_filter(string_split(path, '/'), lambda s: s <> '')[1], '(home)') AS section,
          CASE WHEN regexp_matches(path, '\.pdf$') THEN 'pdf' WHEN regexp_matches(path, '(?i)\.(?:png|jpe?g|gif|webp|svg|ico)$') THEN 'image' ELSE 'page' END AS kind,
          lower(string_split(regexp_replace(url, '/+$', ''), '/')[-1]) = 'contact' AS contact FROM p""",
    "q_section_counts": r"""WITH p AS (SELECT '/' || regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[#?].*$', ''), '^(?:https?:)?//[^/]*', ''), '^/+|/+$', '', 'g') AS path FROM pages)
        SELECT coalesce(list_filter(string_split(path, '/'), lambda s: s <> '')[1], '(home)') AS section, count(*) AS n FROM p GROUP BY ALL""",
    "q_quality_gate": r"""WITH s AS (SELECT doc_id, (doc_id % 10) / 10.0 + 0.2 AS conf, doc_id % 5 = 0 AS is_table, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
        d AS (SELECT *, regexp_replace(t, '\s+', '', 'g') AS dense, list_filter(regexp_split_to_array(t, '[\s|]+'), lambda x: x <> '') AS w FROM s),
        m AS (SELECT *, length(t) AS len, CASE WHEN length(dense) > 0 THEN (length(dense) - length(regexp_replace(dense, '[A-Za-z0-9.,:;()/%&''"\-+#*@\[\]|]', '', 'g')))::DOUBLE / length(dense) ELSE 0 END AS l,
                CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '^(?:[A-Za-z]{2,}|[0-9][0-9.,:/()+\-]*|[A-Za-z0-9][A-Za-z0-9.#_/\-]{0,4})$')))::DOUBLE / len(w) ELSE 0 END AS g FROM d)
        SELECT doc_id, len::BIGINT AS length, round(l, 6) AS letterish, round(g, 6) AS wordish,
          CASE WHEN len < 150 THEN 'too short' WHEN conf < 0.45 THEN 'low confidence' WHEN l < 0.8 THEN 'not document characters'
               WHEN NOT is_table AND g < 0.55 THEN 'not word-shaped' ELSE 'ok' END AS reason FROM m""",
    "q_function_words": f"SELECT doc_id, round({_SHARE}, 6) AS share FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)",
    "q_gazette": rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Results ....... 12' || chr(10) || '3rd Semester' || chr(10) || text ELSE text END AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS w FROM t)
        SELECT doc_id, regexp_matches(substr(text, 1, 600), '\.{{4,}}') AND regexp_matches(array_to_string(string_split(text, chr(10))[1:80], chr(10)), '(?i)\b\d+(?:st|nd|rd|th)\s+sem')
          AND len(w) >= 60 AND {_SHARE} < 12 AS rejected FROM w""",
    "q_toc_headings": r"""WITH t AS (SELECT doc_id, 'Contents ...... 3' || chr(10) || '| a ....... 4' || chr(10) || 'CHAPTER I' || chr(10) || '1.2 Scope of rules' || chr(10) || '2 Not this,' || chr(10) || text AS text
                   FROM documents),
        l AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT (regexp_matches(x, '\.{4,}\s*\d*\s*$') AND NOT contains(x, '|'))), lambda x: trim(x)) AS ls FROM t)
        SELECT doc_id, md5(array_to_string(list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '^(?:(?:PART|CHAPTER)\b.*|\d+(?:\.\d+)*[.)]?\s+[A-Z].*)$')
          AND length(x) <= 90 AND NOT regexp_matches(x, '[,;]$') THEN '## Rules — ' || x ELSE x END), chr(10))) AS text_md5 FROM l""",
    "q_labels": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT doc_id, {BARE.format('line')} AS b FROM l)
        SELECT doc_id, count(*) FILTER (WHERE b = '' OR (length(b) <= 40 AND NOT regexp_matches(b, '(?i)\\d|@|\\b\\w+\\.(?:edu|com|org|net|pk)\\b'))) AS n_labels, count(*) AS n_lines FROM b GROUP BY doc_id""",
    "q_page_links": """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages)
        SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct, min(href) AS first_href FROM l GROUP BY page_id""",
    "q_pdf_discovery": """WITH h AS (SELECT page_id, html || '<a href="/files/rules-' || page_id::VARCHAR || '.pdf#page=2">x</a><a href="/files/rules-' || page_id::VARCHAR || '.pdf">x</a><a href=''/a/prospectus.PDF?v=1''>x</a>' AS html FROM pages),
        l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"''\\s]+\\.pdf[^"''\\s]*)["'']', 1)) AS u FROM h)
        SELECT DISTINCT page_id, regexp_replace(regexp_replace(u, '#.*$', ''), '[).,;]+$', '') AS pdf FROM l""",
    "q_pdf_referrers": r"""WITH p AS (SELECT page_id, '/' || regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[#?].*$', ''), '^(?:https?:)?//[^/]*', ''), '^/+|/+$', '', 'g') AS path FROM pages),
        c AS (SELECT '/files/rules-' || (page_id % 20)::VARCHAR || '.pdf' AS pdf, coalesce(list_filter(string_split(path, '/'), lambda s: s <> '')[1], '(home)') AS category FROM p)
        SELECT pdf, count(*) AS n_pages, coalesce(min(category) FILTER (WHERE category <> 'en'), 'en') AS category, array_to_string(list_sort(list_distinct(list(category))), ',') AS categories FROM c GROUP BY pdf""",
    "q_proposition_parse": r"""WITH r AS (SELECT doc_id, list_filter(list_transform(string_split('1. ' || replace(text, chr(10), chr(10) || '12) ') || chr(10) || '3. short', chr(10)),
            lambda x: trim(regexp_replace(trim(x), '^\d+[.)\-\s]+', ''))), lambda x: length(x) >= 10) AS ps FROM documents)
        SELECT doc_id, (generate_subscripts(ps, 1) - 1)::BIGINT AS prop_index, sha1(unnest(ps)) AS fingerprint FROM r""",
}

QUERIES = {name: globals()[name] for name in SQL}

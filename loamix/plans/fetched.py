"""Queries over fetched pages, lines and files. What the tables lack is put in by rule, and so in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamix.operators import pages as P
from loamix.operators import tables as B
from loamix.plans import table
from loamix.plans.serving import CELLS, cells

LINKS = ("mailto:a@b.org", "#x", "?page=2", "a/b.pdf", "../up/page.html", "//cdn.example.net/x", "/img/a.PNG", "/About/", "./here/", "/files/x.docx", "javascript:go()")
CONTACTS = ("write to a@b.org", "+12 345 678 9012", "example.edu", "Main Road, Town", "(824) 410-051-22", "www.example.org/")
COUNTS = ("18 Programs", "18+\nOfficial Events", "Departments (11)", "7\n8 Labs and (9)", "2024 was good")
CLASSES = ("# Title", "Dr. A — Dean. Email: a@b.org\nshare", "What is it?\nIt is this.", "Why?\nHow?\n| x |", "Semester IV\nsemester iv\nSemester 2", "| CS-101 | Logic |\nBack to home\nA is the Head of the Department", "see https://a.org/x (b@c.org)\n##")
BLOCKS = ("College, Main Road. Phone: 123", "The registrar's email is a@b.org", "Dean Office phone 123", "Oops! gone", "Phone: 1 Email: a@b.org")
TRAIL = ("Read more", "Back to About", "View all of the many programs that we have here in town", "Apply", "")


def _pick(values, key):
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


def _sql(values, key):
    return "list_extract([" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + f"], ({key} % {len(values)} + 1)::BIGINT)"


def q_fetch_reason(spark, sf_dir):
    i, text = F.col("doc_id") % 6, F.col("text")
    fetched = F.when(i == 0, F.lit(None)).when(i == 1, "  ").when(i == 2, F.concat(F.lit("Oops! "), text)).when(i == 3, "short").otherwise(text)
    docs = table(spark, sf_dir, "documents").select("doc_id", fetched.alias("t"))
    return docs.select("doc_id", P.fetch_reason(F.col("t")).alias("reason"), F.length(P.fetched_text(F.col("t"))).cast("bigint").alias("n_kept"))


def q_clean_links(spark, sf_dir):
    from loamix.functions import urls as U

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.concat(U.links(F.col("html")), F.array(*[F.lit(x) for x in LINKS]))).alias("href"))
    link = P.clean_link(F.col("href"), F.col("url"), P.host(F.col("url")))
    return pages.select("page_id", "href", link["url"].alias("link"), link["kind"].alias("kind"))


def q_unknown_links(spark, sf_dir):
    links = q_clean_links(spark, sf_dir).filter("kind = 'page'").select(F.col("link").alias("url"))
    known = table(spark, sf_dir, "pages").select("url").unionByName(links.filter("url like '%/About'"))
    return P.unknown_links(links, known)


def q_prefix_counts(spark, sf_dir):
    from loamix.functions import urls as U

    paths = table(spark, sf_dir, "pages").select(U.path(F.col("url")).alias("path"))
    return P.prefix_counts(paths.select(F.concat(F.lit("/"), F.substring_index(F.substring("path", 2, 10**6), "/", 1)).alias("hub")), paths)


def q_page_title(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    i, text = F.col("doc_id") % 4, F.col("text")
    told = F.when(i == 0, F.concat(F.lit("\n##\n# The  head "), F.col("doc_id").cast("string"), F.lit("\n"), text)).when(i == 1, F.concat(F.lit("| a |\n"), text)).otherwise(text)
    url = F.concat(F.lit("https://example.org/the-"), F.col("source"), F.lit("/one-page"))
    return docs.select("doc_id", P.page_title(told, url).alias("title"))


def q_contact_labels(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.concat("text", F.lit("\n"), _pick(CONTACTS, "doc_id")), "\n")).alias("pos", "line"))
    return lines.groupBy("doc_id", P.contact_label(F.col("line")).alias("label")).agg(F.count("*").alias("n"))


def q_counts_in_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), _pick(COUNTS, "doc_id")).alias("t"))
    return docs.select("doc_id", F.explode(P.counts_in(F.col("t"))).alias("c")).select("doc_id", "c.label", "c.number")


def q_line_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(_pick(CLASSES, "doc_id"), F.lit("\n"), "text").alias("t"))
    return docs.select("doc_id", P.line_classes(F.col("t")).alias("c")).select("doc_id", "c.*")


def q_boilerplate(spark, sf_dir):
    """What each line would lose in a ranking, for a question for contact details and for another."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.concat("text", F.lit("\n"), _pick(BLOCKS, "doc_id")), "\n")).alias("pos", "line"))
    loss = lambda q: P.boilerplate_penalty(F.lit(q), F.col("line"))
    rows = docs.select("doc_id", F.col("pos").cast("bigint").alias("pos"), loss("who is the dean").alias("person"), loss("what is the phone number").alias("contact"))
    return rows.filter("person > 0 or contact > 0")


def q_page_states(spark, sf_dir):
    """Empty pages, and link texts that are only a way on."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("t"), _pick(TRAIL, "page_id").alias("trail"))
    short = F.when(F.col("page_id") % 9 == 0, F.lit("We could not find the requested page")).otherwise(F.col("t"))
    return pages.select("page_id", P.is_empty_page(short).alias("empty"), P.is_link_leftover(F.col("trail")).alias("leftover"))


def q_compared_texts(spark, sf_dir):
    """What an old extraction holds that the new one hasn't, and the other way: of each document against the one with a line more and a line less."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    old = F.concat(F.lit("Menu unheard words entirely\n"), F.col("text"))
    new = F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "\nzzqj xxqv yyqw vvqk uuqz").otherwise(""))
    return P.compared_texts(docs.select("doc_id", old.alias("old"), new.alias("new")), F.col("old"), F.col("new")).drop("old", "new")


def images(spark, sf_dir):
    i = F.col("page_id")
    src = F.concat(F.lit("/img/"), F.when(i % 5 == 0, "logo").otherwise("scan"), (i % 30).cast("string"), F.when(i % 7 == 0, ".svg").otherwise(".JPG"))
    return table(spark, sf_dir, "pages").select("page_id", src.alias("src"), F.md5((i % 30).cast("string").cast("binary")).alias("digest"), (i % 11 * 4000).alias("bytes"))


def q_owned_images(spark, sf_dir):
    return P.owned_images(images(spark, sf_dir))


def q_pdf_kind(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.pmod(F.col("doc_id"), F.lit(50)).alias("pdf"), F.col("doc_id").alias("page_no"), F.when(F.col("doc_id") % 3 > F.col("doc_id") % 50 / 20, F.col("text")).alias("layer"), F.when(F.col("doc_id") % 50 < 40, F.col("text")).alias("ocr"))
    return P.pdf_kind(pages, "pdf")


def q_pdf_verdict(spark, sf_dir):
    i = F.col("page_id")
    status = F.when(i % 10 == 0, F.lit(None)).when(i % 10 == 1, 403).when(i % 10 == 2, 404).otherwise(200)
    verdict = P.pdf_verdict(status, F.when(i % 10 == 3, "text/html").otherwise("application/PDF"), F.when(i % 10 == 4, "<htm").otherwise("%PDF"))
    return table(spark, sf_dir, "pages").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def q_file_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.file_name(F.col("url")).alias("file"))


def q_hubs(spark, sf_dir):
    i = F.col("page_id")
    address = F.when(i % 4 == 0, F.concat(F.lit("/news/"), i.cast("string"))).when(i % 4 == 1, F.concat(F.lit("/a/b"), i.cast("string"), F.lit("/events"))).when(i % 4 == 2, F.concat(F.lit("/p"), (i % 90).cast("string"))).otherwise(F.concat(F.lit("/p/q"), i.cast("string")))
    return P.hubs(table(spark, sf_dir, "pages").select(address.alias("address"), F.when(i % 6 == 0, "no").otherwise("yes").alias("keep"), i.alias("at")))


def q_click_targets(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    text = F.concat(_pick(("View details", "Submit", "Read more", "Home", "Pay and view"), "event_id"), F.lit(" "), F.col("event_type"))
    items = events.select("user_id", F.col("event_id").alias("at"), text.alias("text"), _pick(("a", "div", "input"), "event_id").alias("tag"), (F.col("event_id") % 4).alias("top"), (F.col("event_id") % 3).alias("left"))
    return P.click_targets(items, "user_id")


def q_cell_bands(spark, sf_dir):
    """Cells by the column that they overlap most and the row whose centre is nearest."""
    all_cells = cells(spark, sf_dir, dealt=True)
    placed = B.by_overlap(B.nearest_row(all_cells), B.column_bands(all_cells))
    return placed.groupBy("page_id", "row_no", "band").agg(F.count("*").alias("n"), F.min("text").alias("first_text"))


_ORIGIN = "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
_HOST = "regexp_replace(lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '')"
_PATH = "'/' || regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[#?].*$', ''), '^(?:https?:)?//[^/]*', ''), '^/+|/+$', '', 'g')"
_STEP = "regexp_replace(regexp_replace({0}, '/\\./', '/', 'g'), '/[^/]+/\\.\\./', '/', 'g')"
_LINKS = rf"""hrefs AS (SELECT page_id, url, unnest(list_concat(regexp_extract_all(html, '<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1), {list(LINKS)!r})) AS href FROM pages),
bases AS (SELECT *, trim(href) AS h, {_ORIGIN} AS origin, regexp_replace(url, '[?#].*$', '') AS bare FROM hrefs),
whole AS (SELECT page_id, url, href, CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN 'https:' || h WHEN starts_with(h, '/') THEN origin || h
   WHEN starts_with(h, '#') OR starts_with(h, '?') THEN bare || h
   ELSE CASE WHEN contains(regexp_replace(bare, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/') THEN regexp_replace(bare, '[^/]*$', '') ELSE bare || '/' END || h END AS w FROM bases),
paths AS (SELECT page_id, url, href, regexp_replace({_STEP.format(_STEP.format(_STEP.format(_STEP.format('w'))))}, '#.*$', '') AS w FROM whole),
judged AS (SELECT page_id, href, w, regexp_replace(w, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', '') AS route, {_HOST.format('w')} AS host, {_HOST.format('url')} AS home, {_PATH.format('w')} AS p FROM paths),
links AS (SELECT page_id, href, CASE WHEN ok THEN regexp_replace('https://' || host || route, '/+$', '') END AS link, CASE WHEN ok THEN CASE WHEN regexp_matches(p, '\.pdf$') THEN 'pdf' ELSE 'page' END END AS kind
  FROM (SELECT *, NOT regexp_matches(href, '{P.NO_PAGE}') AND regexp_matches(w, '(?i)^https?://') AND host = home AND NOT contains(w, '?') AND NOT regexp_matches(p, '(?i)\.(?:png|jpe?g|gif|webp|svg|ico)$') AND NOT regexp_matches(route, '{P.DOWNLOAD}') AS ok FROM judged))"""
_any = lambda words, c: "(" + " OR ".join(f"contains({c}, '" + w.replace("'", "''") + "')" for w in words) + ")"
_starts = lambda words, c: "(" + " OR ".join(f"starts_with({c}, '{w}')" for w in words) + ")"
_NORM = r"trim(regexp_replace(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), '^[#•|\s]+', ''))"
_SOLID = "list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_Q = "'"
_ASKS = "(ends_with(regexp_replace({0}, '^[#• ]+', ''), '?') AND length({0}) <= 250)"
_DEAD = r"(?i)(something went wrong|couldn''?t find your page|page not found|\b404\b|back to home|oops)"
_FOLDED = "trim(regexp_replace(regexp_replace(lower({0}), '[#•|]', ' ', 'g'), '\\s+', ' ', 'g'))"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_SHARE = "CASE WHEN len(" + _WORDS + ") = 0 THEN 1.0::DOUBLE ELSE len(list_filter(" + _WORDS + ", lambda v: list_contains({1}, v)))::DOUBLE / len(" + _WORDS + ") END"
_C = lambda s: s.replace("'", "''")

SQL = {
    "q_fetch_reason": rf"""WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'Oops! ' || text WHEN 3 THEN 'short' ELSE text END AS t FROM documents),
        r AS (SELECT doc_id, trim(t) AS b, CASE WHEN t IS NULL THEN 'unreachable' WHEN trim(t) = '' THEN 'empty' WHEN regexp_matches(substr(trim(t), 1, 300), '{_DEAD}') THEN 'dead' WHEN length(trim(t)) < 100 THEN 'too_short' ELSE 'ok' END AS reason FROM f)
        SELECT doc_id, reason, CASE WHEN reason = 'ok' THEN least(length(b), 40000) END::BIGINT AS n_kept FROM r""",
    "q_clean_links": f"WITH {_LINKS} SELECT page_id, href, link, kind FROM links",
    "q_unknown_links": f"""WITH {_LINKS}, found AS (SELECT DISTINCT link AS url, {_PATH.format('link')} AS p FROM links WHERE kind = 'page')
        SELECT url FROM found WHERE p NOT IN (SELECT {_PATH.format('url')} FROM pages) AND p NOT IN (SELECT {_PATH.format('url')} FROM found WHERE url LIKE '%/About')""",
    "q_prefix_counts": f"""WITH p AS (SELECT DISTINCT {_PATH.format('url')} AS path FROM pages), h AS (SELECT DISTINCT '/' || string_split(path, '/')[2] AS hub FROM p)
        SELECT hub, CASE WHEN hub = '/' THEN 0 ELSE (SELECT count(*) FROM p WHERE starts_with(p.path, h.hub || '/')) END::BIGINT AS n FROM h""",
    "q_page_title": r"""WITH t AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN chr(10) || '##' || chr(10) || '# The  head ' || doc_id::VARCHAR || chr(10) || text WHEN 1 THEN '| a |' || chr(10) || text ELSE text END AS t FROM documents),
        l AS (SELECT *, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM t),
        h AS (SELECT *, regexp_replace(list_filter(l, lambda x: starts_with(x, '#') AND regexp_replace(x, '^[# ]+', '') <> '')[1], '^[# ]+', '') AS h FROM l)
        SELECT doc_id, coalesce(h, CASE WHEN length(l[1]) <= 80 AND NOT regexp_matches(l[1], '^[|•]') THEN l[1] END, 'One Page') AS title FROM h""",
    "q_contact_labels": rf"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text || chr(10) || {_sql(CONTACTS, 'doc_id')}, chr(10)))) AS line FROM documents)
        SELECT doc_id, CASE WHEN regexp_matches(line, '{P.EMAIL}') THEN 'Email' WHEN regexp_matches(line, '{P.PHONE}') THEN 'Phone' WHEN regexp_matches(line, '{P.DOMAIN}') THEN 'Website' ELSE 'Address' END AS label, count(*) AS n FROM l GROUP BY ALL""",
    "q_counts_in_text": rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text || chr(10) || {_sql(COUNTS, 'doc_id')}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM documents),
        r AS (SELECT doc_id, unnest(l) AS line, unnest(list_append(l[2:], '')) AS after FROM l),
        c AS (SELECT doc_id, regexp_extract(line, '{_C(P.COUNT_FIRST)}', 2) AS label, regexp_extract(line, '{_C(P.COUNT_FIRST)}', 1) AS number FROM r WHERE regexp_matches(line, '{_C(P.COUNT_FIRST)}')
          UNION ALL SELECT doc_id, after, replace(line, '+', '') FROM r WHERE regexp_matches(line, '{P.COUNT_ALONE}') AND regexp_matches(after, '{_C(P.COUNT_LABEL)}')
          UNION ALL SELECT doc_id, unnest(regexp_extract_all(line, '{_C(P.COUNT_LAST)}', 1)), unnest(regexp_extract_all(line, '{_C(P.COUNT_LAST)}', 2)) FROM r)
        SELECT DISTINCT doc_id, trim(label) AS label, number::INT AS number FROM c""",
    "q_line_classes": rf"""WITH t AS (SELECT doc_id, {_sql(CLASSES, 'doc_id')} || chr(10) || text AS t FROM documents), l AS (SELECT *, {_SOLID.format('t')} AS l FROM t),
        p AS (SELECT *, list_zip(l[1:len(l) - 1], l[2:]) AS z FROM l)
        SELECT doc_id, (len(regexp_extract_all(t, '{P.ADDRESS}')) + len(regexp_extract_all(t, '{P.EMAIL}')))::BIGINT AS n_links, len(list_filter(l, lambda x: contains(x, 'Email:')))::BIGINT AS n_people,
          len(list_filter(z, lambda x: {_ASKS.format('x[1]')} AND NOT {_ASKS.format('x[2]')} AND NOT regexp_matches(x[2], '^[#|]')))::BIGINT AS n_answered, contains(t, 'is the Head of the Department') AS has_head,
          len(list_distinct(list_transform(list_filter(l, lambda x: regexp_matches(x, '{P.SEMESTER}')), lambda x: upper(regexp_extract(x, '{P.SEMESTER}', 1)))))::BIGINT AS n_semesters,
          len(list_filter(l, lambda x: regexp_matches(x, '{P.COURSE_ROW}')))::BIGINT AS n_courses,
          len(list_filter(l, lambda x: regexp_matches(x, '^#+$') OR {_any(P.JUNK_PARTS, _NORM.format('x'))} OR {_NORM.format('x')} IN {P.JUNK_LINES!r} OR {_starts(P.JUNK_STARTS, _NORM.format('x'))}))::BIGINT AS n_junk,
          length(l[1]) BETWEEN 3 AND 150 AND NOT regexp_matches(l[1], '^(?:\||•|#|http)') AS has_title FROM p""",
    "q_boilerplate": rf"""WITH l AS (SELECT doc_id, unnest(string_split(text || chr(10) || {_sql(BLOCKS, 'doc_id')}, chr(10))) AS line, generate_subscripts(string_split(text || chr(10) || {_sql(BLOCKS, 'doc_id')}, chr(10)), 1) - 1 AS pos FROM documents),
        b AS (SELECT doc_id, pos::BIGINT AS pos, regexp_matches(line, '{_DEAD}') AS dead,
                length(line) <= 300 AND (regexp_matches(line, '{_DEAD}') OR (regexp_matches(line, '{P.CONTACT_SIGNAL}') AND NOT regexp_matches(line, '{P.ROLE_WORD}') AND NOT regexp_matches(line, '{P.VERB}'))) AS b FROM l)
        SELECT doc_id, pos, 8.0::DOUBLE AS person, CASE WHEN dead THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END AS contact FROM b WHERE b""",
    "q_page_states": rf"""WITH p AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'We could not find the requested page' ELSE regexp_replace(html, '<[^>]*>', ' ', 'g') END AS t, trim({_sql(TRAIL, 'page_id')}) AS w FROM pages)
        SELECT page_id, length(trim(regexp_replace(t, '\s+', ' ', 'g'))) < 150 OR {_any(P.EMPTY_MARKS, 't')} AS empty, w <> '' AND length(w) <= 40 AND {_starts(P.LEFTOVER_STARTS, 'lower(w)')} AS leftover FROM p""",
    "q_compared_texts": f"""WITH t AS (SELECT doc_id, 'Menu unheard words entirely' || chr(10) || text AS o, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'zzqj xxqv yyqw vvqk uuqz' ELSE '' END AS n FROM documents WHERE text IS NOT NULL),
        ol AS (SELECT doc_id, unnest(string_split(o, chr(10))) AS x FROM t), nl AS (SELECT doc_id, unnest(string_split(n, chr(10))) AS x FROM t),
        v AS (SELECT doc_id, {_FOLDED.format('o')} AS fo, {_FOLDED.format('n')} AS fn, list_distinct({_WORDS.format('o')}) AS wo, list_distinct({_WORDS.format('n')}) AS wn FROM t),
        g AS (SELECT doc_id, sum(length(x)) AS total, sum(CASE WHEN NOT contains(fn, {_FOLDED.format('x')}) AND {_SHARE.format('x', 'wn')} < 0.5 THEN length(x) ELSE 0 END) AS bad FROM ol JOIN v USING (doc_id) WHERE trim(x) <> '' GROUP BY doc_id),
        m AS (SELECT doc_id, count(*) FILTER (WHERE trim(x) <> '' AND length(trim(x)) >= 15 AND NOT contains(fo, {_FOLDED.format('x')}) AND {_SHARE.format('x', 'wo')} < 0.8)::BIGINT AS lost FROM nl JOIN v USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, round(100.0::DOUBLE * bad / total, 1) AS garbage_pct, lost, len(wo)::BIGINT AS old_words, len(wn)::BIGINT AS new_words FROM g JOIN m USING (doc_id) JOIN v USING (doc_id)""",
    "q_owned_images": """WITH i AS (SELECT page_id, '/img/' || CASE WHEN page_id % 5 = 0 THEN 'logo' ELSE 'scan' END || (page_id % 30)::VARCHAR || CASE WHEN page_id % 7 = 0 THEN '.svg' ELSE '.JPG' END AS src, md5((page_id % 30)::VARCHAR) AS digest, page_id % 11 * 4000 AS b FROM pages)
        SELECT digest, min(page_id) AS page_id, first(src ORDER BY page_id, src) AS src, count(DISTINCT page_id) AS n_pages FROM i WHERE contains(src, 'scan') AND contains(src, '.JPG') AND b >= 20000 GROUP BY digest""",
    "q_pdf_kind": """WITH p AS (SELECT doc_id % 50 AS pdf, length(trim(coalesce(CASE WHEN doc_id % 3 > (doc_id % 50) / 20 THEN text END, ''))) >= 60 AS a, length(trim(coalesce(CASE WHEN doc_id % 50 < 40 THEN text END, ''))) > 0 AS o FROM documents),
        c AS (SELECT pdf, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE NOT a AND o) AS b, count(*) AS n_pages FROM p GROUP BY pdf)
        SELECT pdf, CASE WHEN a > 0 AND b > 0 THEN 'mixed' WHEN a > 0 THEN 'digital' WHEN b > 0 THEN 'scanned' ELSE 'empty' END AS kind, n_pages FROM c""",
    "q_pdf_verdict": "SELECT CASE page_id % 10 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'BLOCKED' WHEN 2 THEN 'NOT_A_PDF' WHEN 3 THEN 'NOT_A_PDF' WHEN 4 THEN 'NOT_A_PDF' ELSE 'REAL_PDF' END AS verdict, count(*) AS n FROM pages GROUP BY 1",
    "q_file_names": f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace({_PATH.format('url')}, '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS n FROM pages)
        SELECT page_id, CASE WHEN n = '' THEN 'home' ELSE n END || '.html' AS file FROM p""",
    "q_hubs": """WITH r AS (SELECT CASE page_id % 4 WHEN 0 THEN '/news/' || page_id::VARCHAR WHEN 1 THEN '/a/b' || page_id::VARCHAR || '/events' WHEN 2 THEN '/p' || (page_id % 90)::VARCHAR ELSE '/p/q' || page_id::VARCHAR END AS address, page_id AS at_ FROM pages WHERE page_id % 6 <> 0),
        g AS (SELECT address, len(string_split(address, '/')) - 1 AS n, min(at_) AS at_ FROM r GROUP BY ALL), f AS (SELECT address, CASE WHEN n <= 2 THEN n ELSE 99 END AS d, at_ FROM g WHERE NOT starts_with(address, '/news/'))
        SELECT address, rank FROM (SELECT address, row_number() OVER (ORDER BY d, at_) AS rank FROM f) WHERE rank <= 40""",
    "q_click_targets": r"""WITH i AS (SELECT user_id, event_id AS at_, list_extract(['View details', 'Submit', 'Read more', 'Home', 'Pay and view'], (event_id % 5 + 1)::BIGINT) || ' ' || event_type AS text, event_id % 3 AS tag, event_id % 4 AS top, event_id % 3 AS "left" FROM events)
        SELECT user_id, text, top, "left", min(at_) AS at FROM i WHERE tag <> 2 AND length(text) BETWEEN 1 AND 80 AND NOT regexp_matches(text, '(?i)\b(submit|log ?in|sign ?up|delete|apply now|pay)\b') AND regexp_matches(text, '(?i)\b(view|read|details?|more|show|open|explore)\b') GROUP BY ALL""",
    "q_cell_bands": f"""WITH {CELLS.replace("::DOUBLE AS x0, ", "::DOUBLE AS x0, ((p % 4) * 90 + 60)::DOUBLE AS x1, ", 1)},
        b1 AS (SELECT page_id, col_no AS band, avg(x0) AS lo, any_value(m) AS m FROM c2 GROUP BY ALL), e AS (SELECT page_id, max(x1) + 1 AS e FROM sure GROUP BY page_id),
        b2 AS (SELECT page_id, band, lo, greatest(coalesce(lead(lo) OVER (PARTITION BY page_id ORDER BY band), e.e), lo + 1) AS hi FROM b1 JOIN e USING (page_id)),
        rc AS (SELECT page_id, row_no, avg(y + h / 2) AS c FROM r2 GROUP BY ALL), ids AS (SELECT *, row_number() OVER () AS id FROM cells),
        ro AS (SELECT id, first(rc.row_no ORDER BY abs(y + h / 2 - c), rc.row_no) AS row_no FROM ids JOIN rc USING (page_id) GROUP BY id),
        bo AS (SELECT id, first(band ORDER BY greatest(least(x1, hi) - greatest(x0, lo), -1) DESC, band) AS band FROM ids JOIN b2 USING (page_id) GROUP BY id)
        SELECT page_id, row_no, band, count(*) AS n, min(text) AS first_text FROM ids JOIN ro USING (id) JOIN bo USING (id) GROUP BY ALL""",
}
QUERIES = {name: globals()[name] for name in SQL}

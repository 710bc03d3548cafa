"""Rules on fetched pages: fetch reasons, links, titles, line classes, furniture, click targets, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamix.functions import text as T
from loamix.functions import urls as U

LONGEST_PAGE, SHORTEST_PAGE, LEAST_OWN = 40_000, 100, 150
#: Addresses that are no pages; downloads.
NO_PAGE = r"(?i)^\s*(?:$|mailto:|tel:|javascript:|data:)"
DOWNLOAD = r"(?i)\.(?:docx?|xlsx?|pptx?|zip|rar|mp4|mp3)$"
#: Parts of contact lines.
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"^\+?\d[\d\s()\-]{7,}\d$"
DOMAIN = r"(?i)^(?:https?://)?(?:[\w-]+\.)+(?:edu|com|org|net|pk)(?:\.pk)?/?$"
#: Counts that pages print about themselves.
COUNT_FIRST = r"^(\d{1,3})\+?\s+([A-Za-z][A-Za-z&' ]{2,40})$"
COUNT_ALONE, COUNT_LABEL = r"^\d{1,3}\+?$", r"^[A-Za-z][A-Za-z&' ]{2,40}$"
COUNT_LAST = r"([A-Za-z][A-Za-z&' ]{2,30}?)\s*\((\d{1,3})\)"
#: Line classes.
ADDRESS = r"https?://[^\s)]+"
SEMESTER = r"(?i)^semester\s+([ivx]+|\d+)\b"
COURSE_ROW = r"^\|\s*[A-Z]{2,}[- ]?\d{2,}"
JUNK_PARTS = ("developed by", "skip to main content", "home ›")
JUNK_LINES = ("share", "print", "profile", "read article")
JUNK_STARTS = ("back to", "return to")
LEFTOVER_STARTS = ("back to", "read article", "read more", "view all", "view details", "see more", "see all", "learn more", "return to", "explore all")
EMPTY_MARKS = ("Program Details Not Found", "We could not find the requested")
#: What tells an address block from a sentence.
VERB = (
    r"(?i)\b(is|are|was|were|be|been|has|have|had|can|could|will|would|shall|should|may|must|does|do|did|offers?|provides?|includes?|serves?"
    r"|ensures?|manages?|holds?|awards?|requires?|contacted|located|established|comprises?|consists?|means?|refers?)\b"
)
CONTACT_SIGNAL = r"(?i)(@|phone|email|tel:|\+92|\(824\))"
ROLE_WORD = (
    r"(?i)\b(registrar|controller|treasurer|chancellor|dean|director|principal|hod|head of|professor|prof\.|dr\.|mr\.|ms\.|coordinator"
    r"|officer|incharge|assistant)\b"
)
ASKS_CONTACT = r"(?i)\b(address|located|location|where is|phone|telephone|number|contact|email|e-mail|mail|reach|call|fax|postal|campus address)\b"
BOILERPLATE_CHARS, PENALTY = 300, 8.0
#: Images that are no documents.
IMAGE_FURNITURE = ("logo", "icon", "favicon", "arrow", "button", "avatar", "thumb", "social")
RASTER = (".jpg", ".jpeg", ".png", ".webp")
LEAST_IMAGE_BYTES = 20_000


def any_of(words: tuple[str, ...], text: Column) -> Column:
    hit = F.lit(False)
    for w in words:
        hit |= F.contains(text, F.lit(w))
    return hit


def starts_with_any(words: tuple[str, ...], text: Column) -> Column:
    hit = F.lit(False)
    for w in words:
        hit |= text.startswith(w)
    return hit


# -- fetched pages ------------------------------------------------------------------------------------------------------


def fetch_reason(text: Column) -> Column:
    """Why a page is kept or not; a null text is a page that wasn't reached."""
    bare = F.trim(text)
    return F.when(text.isNull(), "unreachable").when(bare == "", "empty").when(T.looks_dead(bare), "dead").when(F.length(bare) < SHORTEST_PAGE, "too_short").otherwise("ok")


def fetched_text(text: Column) -> Column:
    """The text of a page that is kept, up to the page limit; else none."""
    return F.when(fetch_reason(text) == "ok", F.substring(F.trim(text), 1, LONGEST_PAGE))


def is_empty_page(text: Column) -> Column:
    return F.coalesce((F.length(T.folded(text)) < LEAST_OWN) | any_of(EMPTY_MARKS, text), F.lit(True))


def is_link_leftover(words: Column) -> Column:
    """Whether a link's text is only a way on, such as 'Back to ...'."""
    bare = T.folded(words)
    return (bare != "") & (F.length(bare) <= 40) & starts_with_any(LEFTOVER_STARTS, F.lower(bare))


# -- links --------------------------------------------------------------------------------------------------------------


def resolved(href: Column, base: Column) -> Column:
    """The address that a link on the page `base` leads to."""
    h, origin = F.trim(href), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(F.regexp_replace(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "").contains("/"), F.regexp_replace(bare, "[^/]*$", "")).otherwise(F.concat(bare, F.lit("/")))
    whole = (
        F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("#") | h.startswith("?"), F.concat(bare, h)).otherwise(F.concat(folder, h))
    )
    for _ in range(4):
        whole = F.regexp_replace(whole, r"/\./", "/")
        whole = F.regexp_replace(whole, r"/[^/]+/\.\./", "/")
    return whole


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def clean_link(href: Column, base: Column, domain: Column) -> Column:
    """Struct of url and kind (page or pdf) of a link to follow; null for other hosts, queries, images, downloads and no pages."""
    whole = F.regexp_replace(resolved(href, base), "#.*$", "")
    route = F.regexp_replace(whole, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    ok = ~href.rlike(NO_PAGE) & whole.rlike("(?i)^https?://") & (host(whole) == domain) & ~F.contains(whole, F.lit("?")) & (U.kind(whole) != "image") & ~route.rlike(DOWNLOAD)
    return F.when(ok, F.struct(F.regexp_replace(F.concat(F.lit("https://"), host(whole), route), "/+$", "").alias("url"), U.kind(whole).alias("kind")))


def unknown_links(links: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """Distinct addresses among links whose path is not among those of known."""
    found = links.select(url, U.path(F.col(url)).alias("route")).distinct()
    return found.join(known.select(U.path(F.col(url)).alias("route")).distinct(), "route", "left_anti").select(url)


def prefix_counts(hubs: DataFrame, paths: DataFrame) -> DataFrame:
    """hub, n: how many paths lie under each hub (both by path; the home page has none).

    Each path is taken apart into the paths above it, so no pair is made that doesn't count.
    """
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, i), "/")))
    routes = paths.select(F.col("path")).distinct().withColumn("parts", U.segments(F.col("path"))).filter(F.size("parts") > 1)
    counts = routes.select(F.explode(above).alias("hub")).groupBy("hub").agg(F.count("*").alias("n"))
    return hubs.select("hub").distinct().join(counts, "hub", "left").select("hub", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


# -- titles and lines -----------------------------------------------------------------------------------------------------


def page_title(text: Column, url: Column) -> Column:
    """The first heading with words, else a short first line, else the last part of the address."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    words = lambda x: F.regexp_replace(x, "^[# ]+", "")
    heading = words(F.get(F.filter(lines, lambda x: x.startswith("#") & (words(x) != "")), F.lit(0)))
    first = F.get(lines, F.lit(0))
    slug = F.initcap(F.replace(F.element_at(F.split(U.path(url), "/"), -1), F.lit("-"), F.lit(" ")))
    return F.coalesce(heading, F.when((F.length(first) <= 80) & ~first.rlike("^[|•]"), first), F.when(slug != "", slug), F.lit("Home"))


def contact_label(line: Column) -> Column:
    bare = F.trim(line)
    return F.when(bare.rlike(EMAIL), "Email").when(bare.rlike(PHONE), "Phone").when(bare.rlike(DOMAIN), "Website").otherwise("Address")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_share(line: Column, vocabulary: Column) -> Column:
    """Share of a line's words, repeated ones counted, that are in the vocabulary; 1 for a line without words."""
    own = words(line)
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.filter(own, lambda w: F.array_contains(vocabulary, w))) / F.size(own))


def compared_texts(rows: DataFrame, old: Column, new: Column, garbage: float = 0.5, same: float = 0.8, least: int = 15) -> DataFrame:
    """rows with garbage_pct (of the old text's characters, lines that the new one hasn't), lost (lines of the new one
    that the old hasn't), and the numbers of different words of both.

    What each line is held against stands in a projection of its own; its sizes
    are kept as well, so that it isn't worked out again for every line.
    """
    fold = lambda x: T.folded(F.regexp_replace(F.lower(x), "[#•|]", " "))
    lines = lambda x: F.filter(F.split(x, "\n"), lambda y: F.trim(y) != "")
    chars = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.length(x))
    side = {"o": old, "n": new}
    held = rows.select("*", *[F.struct(fold(c).alias("f"), F.array_distinct(words(c)).alias("w"), lines(c).alias("l")).alias(f"{k}__") for k, c in side.items()])
    bad = F.filter("o__.l", lambda x: ~F.contains("n__.f", fold(x)) & (word_share(x, F.col("n__.w")) < garbage))
    lost = F.filter("n__.l", lambda x: (F.length(F.trim(x)) >= least) & ~F.contains("o__.f", fold(x)) & (word_share(x, F.col("o__.w")) < same))
    total = chars(F.col("o__.l"))
    pct = F.when(total > 0, F.round(100.0 * chars(bad) / total, 1)).otherwise(F.lit(0.0))
    sizes = [F.size(f"{k}__.w").cast("bigint").alias(name) for k, name in (("o", "old_words"), ("n", "new_words"))]
    return held.select(*rows.columns, pct.alias("garbage_pct"), F.size(lost).cast("bigint").alias("lost"), *sizes)


def counts_in(text: Column) -> Column:
    """Array of (label, number): '18 Programs', '18' above 'Programs', 'Programs (18)'."""
    lines = F.filter(F.transform(F.split(text, "\n"), T.folded), lambda x: x != "")
    pair = lambda label, number: F.struct(F.trim(label).alias("label"), number.cast("int").alias("number"))
    follow = F.concat(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), F.array(F.lit("")))

    def of(line: Column, after: Column) -> Column:
        front = F.when(line.rlike(COUNT_FIRST), pair(F.regexp_extract(line, COUNT_FIRST, 2), F.regexp_extract(line, COUNT_FIRST, 1)))
        above = F.when(line.rlike(COUNT_ALONE) & after.rlike(COUNT_LABEL), pair(after, F.replace(line, F.lit("+"))))
        labels, numbers = F.regexp_extract_all(line, F.lit(COUNT_LAST), F.lit(1)), F.regexp_extract_all(line, F.lit(COUNT_LAST), F.lit(2))
        return F.concat(F.filter(F.array(front, above), lambda x: x.isNotNull()), F.zip_with(labels, numbers, pair))

    return F.array_distinct(F.flatten(F.zip_with(lines, F.slice(follow, F.lit(1), F.size(lines)), of)))


def line_classes(text: Column) -> Column:
    """Struct of what a page's lines hold: links, people, answered questions, semesters, course rows, junk, a title."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    count = lambda xs, f: F.size(F.filter(xs, f)).cast("bigint")
    asks = lambda x: F.regexp_replace(x, "^[#• ]+", "").endswith("?") & (F.length(x) <= 250)
    after = F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))
    answered = F.zip_with(F.slice(lines, F.lit(1), F.size(after)), after, lambda x, y: asks(x) & ~asks(y) & ~y.rlike("^[#|]"))
    semesters = F.array_distinct(F.transform(F.filter(lines, lambda x: x.rlike(SEMESTER)), lambda x: F.upper(F.regexp_extract(x, SEMESTER, 1))))

    def junk(x: Column) -> Column:
        key = T.normalised(x)
        return x.rlike("^#+$") | any_of(JUNK_PARTS, key) | key.isin(*JUNK_LINES) | starts_with_any(JUNK_STARTS, key)

    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return F.struct(
        (F.regexp_count(text, F.lit(ADDRESS)) + F.regexp_count(text, F.lit(EMAIL))).cast("bigint").alias("n_links"),
        count(lines, lambda x: F.contains(x, F.lit("Email:"))).alias("n_people"),
        F.size(F.filter(answered, lambda x: x)).cast("bigint").alias("n_answered"),
        F.contains(text, F.lit("is the Head of the Department")).alias("has_head"),
        F.size(semesters).cast("bigint").alias("n_semesters"),
        count(lines, lambda x: x.rlike(COURSE_ROW)).alias("n_courses"),
        count(lines, junk).alias("n_junk"),
        (F.length(first).between(3, 150) & ~first.rlike(r"^(?:\||•|#|http)")).alias("has_title"),
    )


# -- furniture as an answer -------------------------------------------------------------------------------------------------


def is_boilerplate(text: Column, signal: str = CONTACT_SIGNAL) -> Column:
    """An error page or a block of contact fields: short, with a contact signal, no role and no verb. signal: the site's own address may join."""
    has = lambda pattern: text.rlike(T.as_re2(pattern))
    block = has(signal) & ~has(ROLE_WORD) & ~has(VERB)
    return F.coalesce((F.length(text) <= BOILERPLATE_CHARS) & (has(T.DEAD_PAGE) | block), F.lit(False))


def boilerplate_penalty(query: Column, text: Column) -> Column:
    """What furniture loses in a ranking; an error page always, a contact block unless contact details are asked for."""
    dead, asks = text.rlike(T.as_re2(T.DEAD_PAGE)), query.rlike(T.as_re2(ASKS_CONTACT))
    return F.when(is_boilerplate(text) & (dead | ~asks), PENALTY).otherwise(0.0)


# -- images, files, click targets -----------------------------------------------------------------------------------------------


def image_passes(src: Column, on_home: Column) -> Column:
    low = F.lower(src)
    return ~(F.contains(low, F.lit("advertisement")) & ~on_home) & ~any_of(IMAGE_FURNITURE, low) & any_of(RASTER, low)


def owned_images(images: DataFrame, order: str = "page_id") -> DataFrame:
    """Images (page, src, digest, bytes) that are worth reading, each with the first page that shows it."""
    worth = images.filter(image_passes(F.col("src"), F.lit(True)) & (F.col("bytes") >= LEAST_IMAGE_BYTES))
    return worth.groupBy("digest").agg(F.min(order).alias(order), F.min_by("src", F.struct(order, "src")).alias("src"), F.count_distinct(order).alias("n_pages"))


def pdf_kind(pages: DataFrame, doc: str = "doc_id", least: int = 60) -> DataFrame:
    """doc, kind, n_pages of (doc, page_no, layer, ocr): digital, scanned, mixed or empty by where each page's text comes from."""
    has_layer, has_ocr = F.length(F.trim(F.coalesce("layer", F.lit("")))) >= least, F.length(F.trim(F.coalesce("ocr", F.lit("")))) > 0
    told = pages.groupBy(doc).agg(F.count_if(has_layer).alias("a"), F.count_if(~has_layer & has_ocr).alias("b"), F.count("*").alias("n_pages"))
    kind = F.when((F.col("a") > 0) & (F.col("b") > 0), "mixed").when(F.col("a") > 0, "digital").when(F.col("b") > 0, "scanned").otherwise("empty")
    return told.select(doc, kind.alias("kind"), "n_pages")


def pdf_verdict(status: Column, content_type: Column, magic: Column) -> Column:
    return (
        F.when(status.isNull(), "ERROR").when(status.isin(403, 429), "BLOCKED").when((status >= 400) | ~F.contains(F.lower(content_type), F.lit("pdf")), "NOT_A_PDF")
        .when(magic != "%PDF", "NOT_A_PDF").otherwise("REAL_PDF")
    )


def file_name(url: Column) -> Column:
    """A file name for an address: its path in words joined by underscores."""
    name = F.regexp_replace(U.path(url), "[^a-z0-9]+", "_")
    trimmed = F.regexp_replace(name, "^_+|_+$", "")
    return F.concat(F.when(trimmed == "", "home").otherwise(trimmed), F.lit(".html"))


def hubs(rows: DataFrame, most: int = 40) -> DataFrame:
    """address, rank of pages (address, keep, at) to open first: short paths but news stories, then lists of events, in order."""
    parts = U.segments(U.path(F.col("address")))
    story = (F.size(parts) == 2) & (F.get(parts, F.lit(0)) == "news")
    events = F.coalesce(F.try_element_at(parts, F.lit(-1)) == "events", F.lit(False))
    short = (F.size(parts) <= 2) & ~F.coalesce(story, F.lit(False))
    found = rows.filter((F.col("keep") == "yes") & (short | events)).withColumn("depth", F.when(short, F.size(parts)).otherwise(99))
    first = found.groupBy("address").agg(F.min("depth").alias("depth"), F.min("at").alias("at"))
    top = first.orderBy("depth", "at").limit(most)  # a bounded list
    return top.select("address", F.row_number().over(Window.orderBy("depth", "at")).cast("bigint").alias("rank"))


def click_targets(items: DataFrame, by: str = "page_id") -> DataFrame:
    """Safe, wanted items (by, at, text, tag, top, left), each card (text at a place) once."""
    safe = ~F.col("tag").isin("input", "select", "textarea") & F.length("text").between(1, 80) & ~F.col("text").rlike(r"(?i)\b(submit|log ?in|sign ?up|delete|apply now|pay)\b")
    wanted = safe & F.col("text").rlike(r"(?i)\b(view|read|details?|more|show|open|explore)\b")
    return items.filter(wanted).groupBy(by, "text", "top", "left").agg(F.min("at").alias("at"))

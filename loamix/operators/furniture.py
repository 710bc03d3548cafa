"""Corpus-wide cleaning: line frequencies, site furniture, contentless and alias pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamix.functions import text as T

FURNITURE_SHARE = 0.60
CONTACT_SHARE = 0.25
LEAST_PAGES = 20
OWN_BELOW = 4


def page_lines(pages: DataFrame, page: str = "doc_id", text: str = "text") -> DataFrame:
    """page, pos, line, key: one row per line."""
    out = pages.select(page, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return out.withColumn("key", T.normalised(F.col("line")))


def page_keys(pages: DataFrame, page: str = "doc_id", text: str = "text") -> DataFrame:
    """page, key: the distinct line keys of each page, made distinct within the row and so without a shuffle."""
    keys = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), T.normalised), lambda k: k != ""))
    return pages.select(page, F.explode(keys).alias("key"))


def document_frequency(pages: DataFrame, page: str = "doc_id", text: str = "text") -> DataFrame:
    """key, df: on how many pages each line stands."""
    return page_keys(pages, page, text).groupBy("key").agg(F.count("*").alias("df"))


def at_least_share(freq: DataFrame, pages: DataFrame, share: float, least_pages: int) -> DataFrame:
    """Rows of freq on at least that share of all pages; none if there are too few pages to tell."""
    total = pages.agg(F.count("*").alias("n_pages"))
    floor = F.greatest(F.lit(2), F.floor(F.col("n_pages") * share))
    kept = freq.crossJoin(F.broadcast(total)).filter((F.col("n_pages") >= least_pages) & (F.col("df") >= floor))
    return kept.drop("n_pages")


def find_furniture(pages: DataFrame, share: float = FURNITURE_SHARE, least_pages: int = LEAST_PAGES, page: str = "doc_id", text: str = "text") -> DataFrame:
    """key, df of lines that are navigation labels and stand on that share of pages."""
    freq = at_least_share(document_frequency(pages, page, text), pages, share, least_pages)
    return freq.filter(T.is_navigation_label(F.col("key")))


def find_site_contact_lines(pages: DataFrame, on_contact_page: Column, share: float = CONTACT_SHARE, least_pages: int = LEAST_PAGES, institution: str = "", page: str = "doc_id", text: str = "text") -> DataFrame:
    """key, df of contact facts that stand on that share of pages and on a contact page."""
    freq = at_least_share(document_frequency(pages, page, text), pages, share, least_pages)
    own = page_keys(pages.filter(on_contact_page), page, text).select("key").distinct()
    return freq.filter(T.looks_like_contact_fact(F.col("key"), institution)).join(own, "key", "left_semi")


def own_content(pages: DataFrame, below: int = OWN_BELOW, page: str = "doc_id", text: str = "text") -> DataFrame:
    """page, has_own: whether some line that is no label stands on fewer than `below` pages."""
    keys = page_keys(pages, page, text).filter(~T.is_navigation_label(F.col("key")))
    rare = keys.groupBy("key").agg(F.count("*").alias("df")).filter(F.col("df") < below)
    having = keys.join(rare, "key", "left_semi").select(page).distinct().withColumn("own", F.lit(True))
    return pages.select(page).distinct().join(having, page, "left").select(page, F.coalesce("own", F.lit(False)).alias("has_own"))


def find_contentless(pages: DataFrame, below: int = OWN_BELOW, least_pages: int = LEAST_PAGES, page: str = "doc_id", text: str = "text") -> DataFrame:
    total = pages.agg(F.count("*").alias("n_pages"))
    bare = own_content(pages, below, page, text).filter(~F.col("has_own"))
    return bare.crossJoin(F.broadcast(total)).filter(F.col("n_pages") >= least_pages).select(page)


def alias_groups(pages: DataFrame, page: str, url: Column, text: Column) -> DataFrame:
    """page, canonical, group_size: pages with one content key; the canonical address has least slashes, then length."""
    trimmed = F.regexp_replace(F.col("url"), "/+$", "")
    rows = pages.select(page, url.alias("url"), F.sha2(T.content_key(text), 256).alias("key"))
    rank = F.struct((F.length(trimmed) - F.length(F.replace(trimmed, F.lit("/")))).alias("s"), F.length("url").alias("l"), F.col("url").alias("url"))
    groups = rows.withColumn("rank", rank).groupBy("key").agg(F.min("rank").alias("best"), F.count("*").alias("group_size"))
    return rows.join(groups.filter("group_size > 1"), "key").select(page, "url", F.col("best.url").alias("canonical"), "group_size")


def strip_furniture(pages: DataFrame, furniture: DataFrame, page: str = "doc_id", text: str = "text") -> DataFrame:
    """page, text without empty lines and lines of the furniture set.

    A set of keys on a share t of pages has at most (lines a page) / t members,
    so it travels as one row and no text is shuffled.
    """
    keys = furniture.agg(F.collect_set("key").alias("furniture_keys"))

    def stays(line: Column) -> Column:
        key = T.normalised(line)
        return (key != "") & ~F.array_contains("furniture_keys", key)

    kept = F.filter(F.split(text, "\n"), stays)
    return pages.crossJoin(F.broadcast(keys)).select(page, F.array_join(kept, "\n").alias("text"), (F.size(F.split(text, "\n")) - F.size(kept)).alias("n_removed"))


def redundant_propositions(rows: DataFrame) -> DataFrame:
    """(id, drop) for (id, text, category, parent_id): copies in a category go, but for the last live row of a parent."""
    keyed = rows.withColumn("key", T.proposition_key(F.col("text")))
    # aggregates and joins, as one key or the null parent may have very many rows
    firsts = keyed.groupBy(F.col("key").alias("k"), F.col("category").alias("c")).agg(F.min("id").alias("first_id"))
    marked = keyed.join(firsts, F.col("key").eqNullSafe(F.col("k")) & F.col("category").eqNullSafe(F.col("c")))
    marked = marked.withColumn("is_first", F.col("id") == F.col("first_id"))
    family = marked.groupBy(F.col("parent_id").alias("p")).agg(F.max("is_first").alias("any_live"), F.max("id").alias("last_id"))
    told = marked.join(family, F.col("parent_id").eqNullSafe(F.col("p")))
    kept_last = ~F.col("any_live") & (F.col("id") == F.col("last_id"))
    return told.select("id", "parent_id", "category", "key", (~F.col("is_first") & ~kept_last).alias("drop"))


def orphan_stats(lines: DataFrame, page: str = "doc_id") -> DataFrame:
    """page, pos, line of bare numbers without a caption: the next line that isn't blank is none or bare too."""
    solid = lines.withColumn("line", T.folded(F.col("line"))).filter(F.col("line") != "")
    follow = F.lead("line").over(Window.partitionBy(page).orderBy("pos"))
    is_bare = solid.withColumn("bare", F.col("line").rlike(T.BARE_NUMBER)).withColumn("follow", follow)
    return is_bare.filter(F.col("bare") & (F.col("follow").isNull() | F.col("follow").rlike(T.BARE_NUMBER))).select(page, "pos", "line")


def figure_columns(lines: DataFrame, page: str = "doc_id", mark: str = "(no caption)") -> DataFrame:
    """Lines with each figure joined to its caption, and figures beside figures marked."""
    w = Window.partitionBy(page).orderBy("pos")
    figure = lambda c: c.rlike(T.BARE_NUMBER)
    caption = lambda c: c.isNotNull() & ~figure(c) & (F.length(c) <= 60) & c.rlike("[A-Za-z]")
    rows = lines.withColumn("line", T.folded(F.col("line"))).withColumn("nxt", F.lead("line").over(w)).withColumn("prv", F.lag("line").over(w))
    fig = figure(F.col("line"))
    takes = fig & F.coalesce(caption(F.col("nxt")), F.lit(False))
    beside = F.coalesce(figure(F.col("nxt")), F.lit(False)) | F.coalesce(figure(F.col("prv")), F.lit(False))
    taken = F.coalesce(figure(F.col("prv")), F.lit(False)) & caption(F.col("line"))
    out = F.when(takes, F.concat_ws(" ", "line", "nxt")).when(fig & beside, F.concat(F.col("line"), F.lit(f" {mark}"))).otherwise(F.col("line"))
    return rows.filter(~taken).select(page, "pos", out.alias("line"))


def scoped_line_dedup(lines: DataFrame, page: str = "doc_id") -> DataFrame:
    """First of equal lines on a page; table rows count within the last line that is no table row."""
    solid = lines.filter(F.col("key") != "").withColumn("is_row", F.startswith(F.trim("line"), F.lit("|")))
    order = Window.partitionBy(page).orderBy("pos")
    scope = F.last(F.when(~F.col("is_row"), F.col("key")), ignorenulls=True).over(order)
    scoped = solid.withColumn("scope", F.when(F.col("is_row"), F.coalesce(scope, F.lit(""))).otherwise(F.lit("")))
    rank = F.row_number().over(Window.partitionBy(page, "scope", "key", "is_row").orderBy("pos"))
    return scoped.withColumn("rank", rank).filter((F.col("rank") == 1) | F.col("key").rlike(T.BARE_NUMBER)).select(page, "pos", "line")

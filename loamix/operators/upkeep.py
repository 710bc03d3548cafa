"""Keeping a corpus: page pieces, paragraphs, selections, watched runs, notes of a site, measures, logs, questions, requests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamix.operators import pages as P

#: Sections of a site's note, by the kind of fact.
SECTIONS = (
    ("social", "Official social media pages"),
    ("portal", "Portals and services"),
    ("contact", "Contact"),
    ("pdf", "Rules, policies and forms"),
    ("other", "About the university"),
)
LONGEST_MESSAGE, LONGEST_SESSION = 2000, 100


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# -- files --------------------------------------------------------------------------------------------------------------


def page_pieces(blocks: DataFrame, tables: DataFrame, by: tuple[str, ...] = ("doc_id", "page_no")) -> DataFrame:
    """by, text: a page's blocks (x0, y0, x1, y1, text) and tables (the same) from top to bottom.

    Blocks whose centre lies in a table go, as the table says the same. Equal tops: blocks first, then by left edge and text.
    """
    keys = list(by)
    shown = tables.filter(stripped(F.col("text")) != "")
    b, t = blocks.filter(stripped(F.col("text")) != "").alias("b"), shown.alias("t")
    x, y = (F.col("b.x0") + F.col("b.x1")) / 2, (F.col("b.y0") + F.col("b.y1")) / 2
    same = [F.col(f"b.{k}") == F.col(f"t.{k}") for k in keys]
    loose = b.join(t, [*same, x.between(F.col("t.x0"), F.col("t.x1")), y.between(F.col("t.y0"), F.col("t.y1"))], "left_anti")
    part = lambda rows, late: rows.select(*keys, F.struct(F.col("y0").cast("double").alias("y"), F.lit(late).alias("late"), F.col("x0").cast("double").alias("x"), stripped(F.col("text")).alias("s")).alias("p"))
    rows = part(loose, 0).unionByName(part(shown, 1)).groupBy(*keys).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return rows.select(*keys, F.array_join(F.transform("ps", lambda p: p["s"]), "\n").alias("text"))


def paragraph_runs(paragraphs: DataFrame, doc: str = "doc_id", pos: str = "pos", window: int = 3, overlap: int = 1) -> DataFrame:
    """doc, chunk_no, kind, text of a styled file's paragraphs (style, text): heading lines in a row together, plain ones in windows.

    Headings carry # by their level (1 to 4). Paragraphs without words are left out. A file's paragraphs are one row's array:
    their number is bounded by a file.
    """
    level = F.regexp_extract(F.coalesce(F.col("style"), F.lit("")), r"Heading ([1-4])", 1)
    bare = stripped(F.coalesce(F.col("text"), F.lit("")))
    rows = paragraphs.select(doc, F.col(pos).alias("pos"), (level != "").alias("head"), F.when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "), bare)).otherwise(bare).alias("t"), bare.alias("bare"))
    order = Window.partitionBy(doc).orderBy("pos")
    rows = rows.filter("bare <> ''").withColumn("turn", (F.col("head") != F.lag("head").over(order)).cast("int"))
    rows = rows.withColumn("run", F.sum(F.coalesce("turn", F.lit(0))).over(order))
    runs = rows.groupBy(doc, "run", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda p: p["t"]).alias("ts"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size("ts") - window) / F.lit(float(window - overlap))).cast("int") * (window - overlap)), F.lit(window - overlap))
    parts = F.when(F.col("head"), F.array(F.array_join("ts", "\n"))).otherwise(F.transform(starts, lambda i: F.array_join(F.slice("ts", i + 1, window), " ")))
    chunks = runs.select(doc, "run", "head", F.posexplode(parts).alias("i", "text"))
    no = F.row_number().over(Window.partitionBy(doc).orderBy("run", "i"))
    return chunks.select(doc, no.cast("bigint").alias("chunk_no"), F.when(F.col("head"), "headings").otherwise("prose").alias("kind"), "text")


# -- runs over a site ---------------------------------------------------------------------------------------------------


def selection(report: Column) -> Column:
    """Struct of pages, notes and pdfs listed under the first '## Selection' of a report."""
    after = F.regexp_extract(report, r"(?s)(?:^|\n)## Selection[ \t]*\n(.*)", 1)
    part = F.get(F.split(F.concat(F.lit("\n"), after), "\n## "), F.lit(0))
    items = F.transform(F.filter(F.split(part, "\n"), lambda x: x.startswith("- ")), lambda x: F.trim(F.substr(x, F.lit(3))))
    of = lambda mark: F.transform(F.filter(items, lambda x: x.startswith(mark)), lambda x: F.substr(x, F.lit(len(mark) + 1)))
    return F.struct(F.filter(items, lambda x: x.startswith("http")).alias("pages"), of("Note: ").alias("notes"), of("PDF: ").alias("pdfs"))


def watched(visits: DataFrame, run: str = "run") -> DataFrame:
    """run, n_fetched, n_left, smallest_gap of visits (run, seq, started, ended, reason).

    The first page that stays unreachable after its retry ends a run: later ones count as left. The gap is that between
    the end of one fetched page and the start of the next; null for fewer than two. One run's visits are in order of one crawler.
    """
    stop = visits.filter("reason = 'unreachable'").groupBy(run).agg(F.min("seq").alias("stop"))
    rows = visits.join(stop, run, "left").withColumn("left_out", F.coalesce(F.col("seq") > F.col("stop"), F.lit(False)))
    done = rows.filter("not left_out").withColumn("gap", F.col("started") - F.lag("ended").over(Window.partitionBy(run).orderBy("started", "seq")))
    told = done.groupBy(run).agg(F.count("*").alias("n_fetched"), F.min("gap").alias("smallest_gap"))
    left = rows.groupBy(run).agg(F.count_if("left_out").alias("n_left"))
    return left.join(told, run, "left").select(run, F.coalesce("n_fetched", F.lit(0)).cast("bigint").alias("n_fetched"), "n_left", "smallest_gap")


def page_result(reason: Column, stored: Column, interrupted: Column) -> Column:
    """What became of a selected page; a null reason is a page that wasn't visited."""
    return F.when(reason.isNull(), "not_fetched").when(reason != "ok", reason).when(stored, "ok").when(interrupted, "not_cleaned").otherwise("not_stored")


def picked(pages: DataFrame, picks: list[tuple[str, int, Column]], address: str = "address", seen: str = "seen") -> DataFrame:
    """slot, address, seen of pages chosen for each slot (name, count, rule) in turn: new pages first, by address, none twice.

    An earlier slot takes at most the sum of all counts from a later one, so that many of each slot's pages suffice to choose among.
    """
    total = sum(n for _, n, _ in picks)
    hits = F.array(*[F.when(rule, F.lit(i)) for i, (_, _, rule) in enumerate(picks)])
    once = pages.groupBy(address).agg(F.max(seen).alias(seen)).withColumnsRenamed({address: "address", seen: "seen"})
    rows = once.withColumnRenamed("address", address).withColumn("slots", F.filter(hits, lambda x: x.isNotNull()))
    rows = rows.select(F.col(address).alias("address"), "seen", F.explode("slots").alias("slot"))
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("slot").orderBy("seen", "address"))).filter(F.col("r") <= total)
    counts, names = [n for _, n, _ in picks], [name for name, _, _ in picks]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: dict[str, tuple[int, bool]] = {}
        for slot, rows in pdf.sort_values(["slot", "r"]).groupby("slot"):
            free = [x for x in rows.itertuples(index=False) if x.address not in taken][: counts[slot]]
            taken |= {x.address: (slot, x.seen) for x in free}
        return pd.DataFrame([(names[s], a, bool(old)) for a, (s, old) in taken.items()], columns=["slot", "address", "seen"])

    return best.select("slot", "r", "address", "seen").groupBy(F.lit(0).alias("all")).applyInPandas(choose, "slot string, address string, seen boolean")


def with_extras(guaranteed: DataFrame, crawled: DataFrame, url: str = "url") -> DataFrame:
    """url, origin: the guaranteed addresses and those found beside them; slashes at the end don't count, each address once."""
    key = F.regexp_replace(F.col(url), "/+$", "")
    rows = guaranteed.select(key.alias(url), F.lit(0).alias("o")).unionByName(crawled.select(key.alias(url), F.lit(1).alias("o")))
    return rows.filter(F.col(url) != "").groupBy(url).agg(F.when(F.min("o") == 0, "guaranteed").otherwise("extra").alias("origin"))


def measured_or_kept(new: DataFrame, old: DataFrame, n_pages: DataFrame, least: int) -> DataFrame:
    """The new measures, or the old ones if the run had too few pages to measure (n_pages: one row, n)."""
    enough = F.broadcast(n_pages.select((F.col("n") >= least).alias("enough_")).limit(1))
    fresh = new.crossJoin(enough).filter("enough_").drop("enough_")
    return fresh.unionByName(old.crossJoin(enough).filter("not enough_").drop("enough_"))


def merged_log(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """One row a key: that of the new log if it has one (its greatest by the other columns), else the old one."""
    others = [c for c in old.columns if c != key]
    rows = old.withColumn("age_", F.lit(0)).unionByName(new.withColumn("age_", F.lit(1)))
    best = rows.groupBy(key).agg(F.max(F.struct("age_", *others)).alias("b_"))
    return best.select(key, *[F.col("b_")[c].alias(c) for c in others])


# -- the note of a site ---------------------------------------------------------------------------------------------------


def site_facts(facts: DataFrame, site: str = "site") -> DataFrame:
    """site, section, line: each fact (site, page_id, pos, on_home, kind, words, value) once, that of the home page first.

    Phone numbers are told apart by their digits, links by their address, all else without regard to case.
    """
    names = [k for k, _ in SECTIONS]
    value, linked = F.trim(F.col("value")), F.col("kind").isin("social", "portal", "pdf")
    label = P.contact_label(value)
    key = F.when((F.col("kind") == "contact") & (label == "Phone"), F.regexp_replace(value, r"\D", "")).when(linked, value).otherwise(F.lower(value))
    line = F.when(linked, F.concat_ws(": ", "words", value)).when(F.col("kind") == "contact", F.concat_ws(": ", label, value)).otherwise(value)
    section = F.array_position(F.array(*map(F.lit, names)), F.col("kind")).cast("int")
    place = F.struct((~F.col("on_home")).alias("later"), "page_id", "pos")
    rows = facts.select(site, section.alias("section"), key.alias("key"), place.alias("place"), line.alias("line")).filter("section > 0 and key <> ''")
    once = rows.groupBy(site, "section", "key").agg(F.min(F.struct("place", "line")).alias("x"))
    first = once.groupBy(site, F.lower("x.line").alias("low")).agg(F.min(F.struct("section", "x.place", "x.line")).alias("y"))
    return first.select(site, "y.section", "y.place", "y.line")


def site_note(facts: DataFrame, institution: str, site: str = "site") -> DataFrame:
    """site, note: a title, and under the title of each section that has any its lines."""
    rows = site_facts(facts, site)
    titles = F.array(*[F.lit(t) for _, t in SECTIONS])
    parts = rows.groupBy(site, "section").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("ls"))
    text = F.concat(F.get(titles, F.col("section") - 1), F.lit(":\n"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))
    whole = parts.select(site, F.struct("section", text.alias("text")).alias("p")).groupBy(site).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return whole.select(site, F.concat(F.lit(f"{institution} — official links and contacts\n"), F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n")).alias("note"))


# -- questions and requests ---------------------------------------------------------------------------------------------


def questions_of(rows: DataFrame, skipped: tuple[str, ...] = ()) -> DataFrame:
    """id, category, question, answer of rows whose id starts with Q and that have both texts; skipped ids are left out."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    kept = rows.filter(F.col("id").startswith("Q") & ~F.col("id").isin(*skipped) & has("question") & has("answer"))
    return kept.select("id", F.when(has("category"), F.col("category")).otherwise("Unknown").alias("category"), F.trim("question").alias("question"), F.trim("answer").alias("answer"))


def request_accepted(message: Column, session: Column) -> Column:
    """Whether a chat request is within the limits of its texts; a missing one isn't."""
    within = lambda c, most: F.coalesce(F.length(c).between(1, most), F.lit(False))
    return within(message, LONGEST_MESSAGE) & within(session, LONGEST_SESSION)

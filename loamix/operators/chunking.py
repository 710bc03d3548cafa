"""Splitting texts: sections, windows, recursive pieces, parents and children, propositions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION, OVERLAP = 1500, 150
PARENT, PARENT_OVERLAP, CHILD, CHILD_OVERLAP = 800, 50, 200, 20
SEPARATORS = ("\n\n", "\n", ". ", " ")
HEADING = r"^#{1,4}\s+"


def sections(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section_no, heading, content: lines (key, pos, line) cut at headings; what precedes the first is Introduction."""
    w = Window.partitionBy(key).orderBy("pos")
    is_heading = F.col("line").rlike(HEADING)
    marked = lines.withColumn("h", is_heading).withColumn("section_no", F.sum(is_heading.cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("pos", "line"))))
    out = marked.groupBy(key, "section_no").agg(F.max(F.when(F.col("h"), F.regexp_replace("line", HEADING, ""))).alias("heading"), body.alias("body"))
    content = F.array_join(F.transform("body", lambda x: x["line"]), "\n")
    return out.select(key, F.col("section_no").cast("bigint").alias("section_no"), F.coalesce("heading", F.lit("Introduction")).alias("heading"), content.alias("content"))


def pieces_of(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters, cut at the coarsest separator that allows it.

    A piece begins with up to `overlap` characters of the piece before it, from
    a place where a separator stood. Text without any separator is cut by size.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep else ()
    parts = text.split(sep) if sep else [text[i : i + size] for i in range(0, len(text), size)]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if piece := sep.join(held).strip():
            out.append(piece)

    for part in parts:
        if len(part) > size:
            flush()
            held = []
            out += pieces_of(part, size, overlap, finer)
            continue
        if held and len(sep.join([*held, part])) > size:
            flush()
            while held and (len(sep.join(held)) > overlap or len(sep.join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def recursive_split(text: Column, size: int, overlap: int) -> Column:
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces_of(t or "", size, overlap))

    return split(text)


def section_chunks(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of sections: short ones whole, long ones in pieces that carry the heading. Only long ones meet Python."""
    whole = F.concat_ws("\n", "heading", "content")
    short = parts.filter(F.length(whole) <= SECTION).select(key, "section_no", F.lit(0).alias("piece"), whole.alias("chunk"))
    long = parts.filter(F.length(whole) > SECTION).select(key, "section_no", "heading", F.posexplode(recursive_split(F.col("content"), SECTION - 100, OVERLAP)).alias("piece", "p"))
    head = F.when(F.col("piece") == 0, F.col("heading")).otherwise(F.concat(F.lit("["), F.col("heading"), F.lit(" — continued]")))
    return short.unionByName(long.select(key, "section_no", "piece", F.concat_ws("\n", head, "p").alias("chunk")))


def parents_and_children(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, parent_no, parent_id, parent, child_no, child. Parents under 50 and children under 20 characters go."""
    parents = docs.select(key, F.posexplode(recursive_split(F.col(text), PARENT, PARENT_OVERLAP)).alias("parent_no", "parent")).filter(F.length(F.trim("parent")) >= 50)
    parent_id = F.sha1(F.concat_ws("|", F.col(key).cast("string"), "parent_no", "parent").cast("binary"))
    children = parents.select("*", parent_id.alias("parent_id"), F.posexplode(recursive_split(F.col("parent"), CHILD, CHILD_OVERLAP)).alias("child_no", "child"))
    return children.filter(F.length(F.trim("child")) >= 20)


def sentence_windows(paragraphs: Column, size: int = 3, step: int = 2) -> Column:
    """Windows of paragraphs from every step-th on, until none is left; few paragraphs are one window."""
    n = F.size(paragraphs)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(step))
    several = F.transform(starts, lambda i: F.array_join(F.slice(paragraphs, i, size), "\n"))
    return F.when(n <= size, F.array(F.array_join(paragraphs, "\n"))).otherwise(several)


def propositions(parents: DataFrame, reply: Column, known: DataFrame | None = None) -> DataFrame:
    """parent_id, prop_index, text, kind: statements of the extractor's reply, or the parent's own text where there are none."""
    from loamix.functions.text import propositions_of

    fresh = parents if known is None else parents.join(known.select("fingerprint"), "fingerprint", "left_anti")
    rows = fresh.withColumn("props", propositions_of(reply))
    found = rows.filter(F.size("props") > 0).select("parent_id", F.posexplode("props").alias("prop_index", "text"), F.lit("proposition").alias("kind"))
    rest = rows.filter(F.coalesce(F.size("props"), F.lit(0)) <= 0).select("parent_id", F.lit(0).alias("prop_index"), F.col("content").alias("text"), F.lit("proposition_fallback").alias("kind"))
    return found.unionByName(rest)

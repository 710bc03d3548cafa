"""Chunk metadata and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamix.functions import text as T
from loamix.functions import urls as U

#: Fixed values of the content type rules, in their order.
LEADERSHIP = ("vc-message", "pro-vc", "dean-message", "registrar-message", "vice-chancellor", "hod-message", "chairman-message", "director-message", "principal-message")
POLICY = ("rule", "policy", "conduct", "disciplinary", "anti-drug")
OFFICES = ("office-of-", "offices/", "/oric", "/dqe", "/fao", "office-of-registrar", "office-of-treasurer", "controller-of-examination", "directorate-of")
OVERVIEW = ("about", "overview", "vc-message", "contact")
#: Limits of the gate for recognised text.
LEAST_CHARS, LEAST_CONFIDENCE, LEAST_LETTERS, LEAST_WORDS = 150, 0.45, 0.80, 0.55
FUNCTION_WORDS = ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "this", "are", "or", "from", "at", "which", "shall", "will", "any", "may", "been", "has", "have")


def any_in(words: tuple[str, ...], text: Column) -> Column:
    hit = F.lit(False)
    for w in words:
        hit |= F.contains(text, F.lit(w))
    return hit


def content_type(source: Column, category: Column, source_type: Column) -> Column:
    low, segs = F.lower(source), U.segments(U.path(source))
    first, second = F.coalesce(F.get(segs, F.lit(0)), F.lit("")), F.coalesce(F.get(segs, F.lit(1)), F.lit(""))
    return (
        F.when(F.contains(low, F.lit("/#site-info-")), "site_info")
        .when(F.contains(low, F.lit("/#pages-")), "page_directory")
        .when((first == "about") & (F.size(segs) == 2) & (second.endswith("-message") | (second == "leadership")), "leadership_message")
        .when((first == "offices") | ((first == "research") & (second == "oric")), "office_info")
        .when((first == "academics") & second.isin("faculty", "departments"), "faculty_page")
        .when(any_in(LEADERSHIP, low), "leadership_message")
        .when(F.contains(low, F.lit("faculty")), "faculty_page")
        .when(any_in(POLICY, low), "policy_document")
        .when(F.contains(low, F.lit("admission")), "admission_info")
        .when(F.contains(low, F.lit("fee")), "fee_structure")
        .when(any_in(OFFICES, low), "office_info")
        .when(source_type == "faq", "faq_entry")
        .when((category == "overview") | any_in(OVERVIEW, low), "overview_page")
        .otherwise("general_page")
    )


def build(chunks: DataFrame, source: Column, category: Column, source_type: Column, text: Column, page_hash: Column, *keep: str) -> DataFrame:
    """The fixed metadata of each chunk, in one projection."""
    return chunks.select(
        *keep,
        source.alias("source"),
        source_type.alias("source_type"),
        category.alias("category"),
        U.department(source).alias("department"),
        content_type(source, category, source_type).alias("content_type"),
        T.section_of_chunk(text).alias("section"),
        T.contains_person(text).alias("contains_person"),
        T.doc_year(text).alias("doc_year"),
        T.content_hash(text).alias("content_hash"),
        F.length(text).cast("bigint").alias("char_count"),
        page_hash.alias("page_hash"),
    )


def gate(text: Column, confidence: Column, is_table: Column) -> Column:
    """Reason for which recognised text is kept out, or ok."""
    s = T.ocr_signals(text)
    return (
        F.when(s["length"] < LEAST_CHARS, "too short")
        .when(confidence < LEAST_CONFIDENCE, "low confidence")
        .when(s["letterish"] < LEAST_LETTERS, "not document characters")
        .when(~is_table & (s["wordish"] < LEAST_WORDS), "not word-shaped")
        .otherwise("ok")
    )


def is_gazette(text: Column) -> Column:
    """A result gazette: dot leaders early, a semester heading, many words and few function words."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 80), "\n")
    words = F.size(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))
    return (
        F.substring(text, 1, 600).rlike(r"\.{4,}")
        & head.rlike(r"(?i)\b\d+(?:st|nd|rd|th)\s+sem")
        & (words >= 60)
        & (T.function_word_share(text, list(FUNCTION_WORDS)) < 12)
    )

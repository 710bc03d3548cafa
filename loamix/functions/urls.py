"""URL helpers, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the structural category rules.
CONTACT_TOKENS = ("contact", "directory")
ADMISSION_TOKENS = ("admission", "admissions", "scholarship", "scholarships", "fee", "fees", "prospectus", "eligibility")
POLICY_TOKENS = ("rule", "rules", "policy", "policies", "conduct", "regulations", "ordinance", "act")
MOST_REFERENCE_TOKENS = 3
EXCLUDED = ("tag", "tags", "author", "feed", "login", "gallery", "category", "wp-content", "wp-admin", "wp-json")
DOCUMENT = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|zip)$"
IMAGE = r"(?i)\.(?:png|jpe?g|gif|webp|svg|ico)$"
PDF_LINK = r"""(?i)href\s*=\s*["']([^"'\s]+\.pdf[^"'\s]*)["']"""


def path(url: Column) -> Column:
    """Lower-case path without scheme, host, query, fragment and outer slashes; the home page is /."""
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "[#?].*$", "")
    text = F.regexp_replace(text, "^(?:https?:)?//[^/]*", "")
    return F.concat(F.lit("/"), F.regexp_replace(text, "^/+|/+$", ""))


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


def tokens(segment: Column) -> Column:
    return F.filter(F.split(segment, "[-_.]+"), lambda t: t != "")


def normalised(url: Column) -> Column:
    """https, no www., no fragment, no slash at the end; the query stays."""
    text = F.regexp_replace(F.trim(url), "#.*$", "")
    text = F.regexp_replace(text, "^(?i)http://", "https://")
    return F.regexp_replace(F.regexp_replace(text, "^https://(?i)www\\.", "https://"), "/+$", "")


def kind(url: Column) -> Column:
    p = path(url)
    return F.when(p.rlike(r"\.pdf$"), "pdf").when(p.rlike(IMAGE), "image").otherwise("page")


def section(url: Column) -> Column:
    return F.coalesce(F.get(segments(path(url)), F.lit(0)), F.lit("(home)"))


def is_contact_page(url: Column) -> Column:
    return F.lower(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)) == "contact"


def department(url: Column) -> Column:
    segs = segments(path(url))
    of = (F.size(segs) >= 3) & (F.get(segs, F.lit(0)) == "academics") & (F.get(segs, F.lit(1)) == "departments")
    return F.when(of, F.get(segs, F.lit(2))).when(F.lower(url).rlike("rule|policy|conduct|disciplinary|anti-drug"), "all").otherwise("general")


def any_of(words: tuple[str, ...], found: Column) -> Column:
    return F.arrays_overlap(F.array(*[F.lit(w) for w in words]), found)


def category(url: Column) -> Column:
    """Category by the shape of the path; null for pages that are not kept."""
    segs = segments(path(url))
    first, second = F.coalesce(F.get(segs, F.lit(0)), F.lit("")), F.coalesce(F.get(segs, F.lit(1)), F.lit(""))
    last = F.coalesce(F.element_at(segs, -1), F.lit(""))
    head, tail = tokens(first), tokens(last)
    short = F.size(head) <= MOST_REFERENCE_TOKENS
    paged = (F.size(segs) >= 2) & (F.get(segs, F.size(segs) - 2) == "page") & last.rlike("^[0-9]+$")
    return (
        F.when(any_of(EXCLUDED, segs) | F.coalesce(paged, F.lit(False)), F.lit(None).cast("string"))
        .when(F.size(segs) == 0, "general")
        .when(any_of(CONTACT_TOKENS, head) | any_of(CONTACT_TOKENS, tail), "general")
        .when((first == "academics") & second.isin("departments", "faculty"), "faculty")
        .when((first == "academics") & second.isin("programs", "undergraduate", "graduate"), "admissions")
        .when((first == "research") & (second == "oric"), "offices")
        .when((first == "faculty") | (first.startswith("faculty") & short), "faculty")
        .when(F.array_contains(head, "department") & short, "faculty")
        .when(first.rlike("^(office|directorate)") & (F.size(head) <= 5), "offices")
        .when(any_of(ADMISSION_TOKENS, head), "admissions")
        .when(first.rlike("^(undergraduate|graduate|postgraduate|program|fee|prospectus)") & short, "admissions")
        .when(any_of(POLICY_TOKENS, head) | any_of(POLICY_TOKENS, tail), "policy")
        .when((first == "about") | (first.startswith("about") & short), "overview")
        .when(first.endswith("-message") & short, "overview")
        .otherwise("general")
    )


def title_from_file(url: Column) -> Column:
    name = F.regexp_replace(F.element_at(F.split(path(url), "/"), -1), r"\.[a-z0-9]+$", "")
    return F.initcap(F.trim(F.regexp_replace(name, "[-_.%0-9]+", " ")))


def pdf_links(html: Column) -> Column:
    """Distinct links to PDF files, without fragments and marks at their end."""
    found = F.regexp_extract_all(html, F.lit(PDF_LINK), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "[).,;]+$", "")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))

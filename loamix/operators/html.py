"""Page text with its structure marked: headings, list items and table rows; and the line filter behind it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamix.functions import text as T
from loamix.operators import furniture

SKIPPED = frozenset("script style noscript svg iframe template head".split())
CHROME = frozenset("nav header footer aside form".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BREAKS = CHROME | frozenset("p div section article main table tbody thead tr li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote br hr".split())
#: Fixed value: words that stay though they are short.
SHORT_WORDS = ("cs", "vc", "it", "hod", "bs", "ms", "phd")


class Lines(HTMLParser):
    """Lines of a page: # before headings, a bullet before list items, pipes around table cells; chrome is left out."""

    def __init__(self, skipped: frozenset[str] = SKIPPED | CHROME) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped = skipped
        self.lines: list[str] = []
        self.held: list[str] = []
        self.off: list[str] = []  # open elements whose text is left out
        self.mark = ""
        self.row: list[str] | None = None
        self.links: list[tuple[str, str]] = []
        self.href: str | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.lines.append(self.mark + text)
        self.mark = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.skipped:
            self.off.append(tag)
        if self.off:
            return
        if tag == "tr":
            self.flush()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.held = []
        elif tag in BREAKS and self.row is None:
            self.flush()
            self.mark = "# " if tag in ("h1", "h2", "h3", "h4") else "• " if tag == "li" else ""
        if tag == "a":
            self.href = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if self.off:
            if tag in self.off:
                del self.off[len(self.off) - 1 - self.off[::-1].index(tag) :]
            return
        if tag in ("td", "th") and self.row is not None:
            self.row.append(" ".join("".join(self.held).split()))
            self.held = []
        elif tag == "tr" and self.row is not None:
            if any(self.row):
                self.lines.append("| " + " | ".join(self.row) + " |")
            self.row, self.held = None, []
        elif tag in BREAKS and tag not in VOID and self.row is None:
            self.flush()
        if tag == "a":
            self.href = None

    def handle_data(self, data):
        if not self.off:
            self.held.append(data)
            if self.href and data.strip():
                self.links.append((" ".join(data.split()), self.href))


def page_lines(html: str | None) -> list[str]:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.lines


def extracted(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """page, pos, line of every page."""
    kind = pages.schema[page].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({page: batch[page], "lines": [page_lines(h) for h in batch[html]]})

    lines = pages.select(page, html).mapInPandas(run, f"{page} {kind}, lines array<string>")
    return lines.select(page, F.posexplode("lines").alias("pos", "line"))


def is_noise(line: Column) -> Column:
    """Short lines that are neither figures nor known words, bare addresses, and lines of code."""
    bare = F.lower(T.bare(line))
    short = (F.length(line) < 3) & ~bare.isin(*SHORT_WORDS) & ~line.rlike(r"^\d+[%+]?$")
    return short | (line.startswith("http") & ~F.contains(line, F.lit(" "))) | (line.rlike("[{};]") & (F.size(F.split(line, r"\s+")) < 6))


def filtered(lines: DataFrame, page: str = "page_id") -> DataFrame:
    """Lines without noise, each once on its page; table rows once within their table."""
    rows = lines.filter(~is_noise(F.col("line"))).withColumn("key", T.normalised(F.col("line")))
    return furniture.scoped_line_dedup(rows, page)


def page_text(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """page, text of pages that have any; the lines of a page meet again by its id."""
    kept = filtered(extracted(pages, page, html), page)
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return kept.groupBy(page).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


#: Letters that `fold` leaves, and how many pages and lines are compared at a time.
LETTERS, PAGES_AT_ONCE, LINES_AT_ONCE = "0123456789abcdefghijklmnopqrstuvwxyz ", 1024, 512


def fold(line: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in line.lower()).split())


def letter_counts(lines: list[str]) -> np.ndarray:
    """How often each letter is in each line."""
    out = np.zeros((len(lines), len(LETTERS)), np.float32)
    for i, line in enumerate(lines):
        for c, n in Counter(line).items():
            out[i, LETTERS.index(c)] = n
    return out


def in_steps(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """A one for each step up to a count, so that a product of two rows is the number of letters that both have."""
    return np.concatenate([counts[:, [c]] >= np.arange(1, most[c] + 1) for c in range(len(most))], axis=1).astype(np.float32)


def recurring(pages: list[list[str]], asked: set[str], need: int, likeness: float) -> set[str]:
    """Those of the asked folded lines that resemble a line of at least `need` pages, each being on one of them.

    Equal lines are counted first. Of the others, most share too few letters
    with the lines of enough pages, which matrix products tell; a ratio is
    taken for what is left only, until a line's verdict stands.
    """
    from loamix.operators.scorers import gestalt_ratio

    pages = [sorted(set(p) - {""}) for p in pages]
    pages = [p for p in pages if p]
    same = Counter(k for p in pages for k in p)
    found = {a for a in asked if same[a] >= need}
    left = sorted(asked - found)
    if len(pages) < need or not left:
        return found
    counts = letter_counts(left)
    most = counts.max(axis=0).astype(int)
    lengths, steps, hits, alive = np.array([len(a) for a in left], np.float32), in_steps(counts, most), np.zeros(len(left), int), np.arange(len(left))
    for at in range(0, len(pages), PAGES_AT_ONCE):
        part = pages[at : at + PAGES_AT_ONCE]
        names = sorted({k for p in part for k in p})
        place = {k: i for i, k in enumerate(names)}
        columns, starts = [place[k] for p in part for k in p], np.cumsum([0, *map(len, part[:-1])])
        other, size = in_steps(letter_counts(names), most).T, np.array([len(k) for k in names], np.float32)
        for a in range(0, len(alive), LINES_AT_ONCE):
            own = alive[a : a + LINES_AT_ONCE]
            can = steps[own] @ other >= likeness * (lengths[own, None] + size) / 2 - 1e-3
            hits[own] += np.logical_or.reduceat(can[:, columns], starts, axis=1).sum(axis=1)
        alive = alive[hits[alive] + len(pages) - at - len(part) >= need]
    for i in alive:
        a, told, got = left[i], {}, 0
        letters = Counter(a)
        for n, page in enumerate(pages):
            for b in page:
                if b not in told:
                    least = likeness * (len(a) + len(b)) / 2
                    told[b] = a == b or min(len(a), len(b)) >= least and (letters & Counter(b)).total() >= least and gestalt_ratio(a, b) >= likeness
            got += any(told[b] for b in page)
            if got >= need or got + len(pages) - n - 1 < need:
                break
        if got >= need:
            found.add(a)
    return found


def running_lines(pages: DataFrame, doc: str, page_no: str, text: str, zone: int = 3, longest: int = 120, likeness: float = 0.75, share: float = 0.6, least_pages: int = 3) -> DataFrame:
    """doc, page_no, text without page numbers and letterheads: lines at a page's edge that resemble one at the edges of enough other pages.

    Documents come one at a time; a document's pages are a bounded group.
    """
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in (doc, page_no))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(page_no)
        split = [t.split("\n") for t in pdf[text]]
        if len(split) >= least_pages:
            edges = [sorted({*range(min(zone, len(x))), *range(max(0, len(x) - zone), len(x))}) for x in split]
            keys = [{j: fold(x[j]) for j in e} for x, e in zip(split, edges)]
            is_number = lambda key: not key or key.removeprefix("page ").replace(" of ", " ").replace(" ", "").isdigit()
            judged = [[j for j in e if (line := x[j].strip()) and "|" not in line and len(line) <= longest] for x, e in zip(split, edges)]
            asked = {own[j] for own, js in zip(keys, judged) for j in js if not is_number(own[j])}
            common = recurring([list(own.values()) for own in keys], asked, max(2, round(share * len(split))), likeness)
            out = []
            for lines, own, js in zip(split, keys, judged):
                drop = {j for j in js if is_number(own[j]) or own[j] in common}
                out.append("\n".join(x for j, x in enumerate(lines) if j not in drop))
            pdf = pdf.assign(**{text: out})
        return pdf[[doc, page_no, text]]

    return pages.select(doc, page_no, text).groupBy(doc).applyInPandas(run, f"{kinds}, {text} string")

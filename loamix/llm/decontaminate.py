"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every word sequence of the normalised items. A document's
words stream through it; at each word the length of the longest sequence that
ends there and occurs in an item is known. A match of `window` words, or of the
whole of a shorter item, is a hit; its words form spans that may be removed.

Defined cases: a null or empty text has no words and no hits; an item without
words or with a null id or text is ignored; rows that share an item id are one
item; rows of documents are judged singly, so repeated rows repeat; an empty
benchmark leaves every document clean; further columns pass through `clean`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamix.llm.common import Shared, numbered, sliced, texts

#: Bytes that separate words become spaces, A-Z become a-z; bytes over 0x7F are parts of words.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WINDOW = 10
#: Words of items in one automaton (about 200 bytes each); more items make further automata, each in a pass of its own.
AUTOMATON_WORDS = 1_000_000


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        # string of a given length at a state: held by one state on its chain of links
        self.whole: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        own_short: dict[int, dict[int, set[str]]] = {}
        for item, words in items:
            state = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                if i + 1 >= window:
                    self.whole.setdefault(self._holder(state, window), set()).add(item)
            if 0 < len(words) < window:
                own_short.setdefault(self._holder(state, len(words)), {}).setdefault(len(words), set()).add(item)
        self.shortest = min([window, *(len(w) for _, w in items if w)])
        self.window_state = [self._holder(s, window) if n >= window else -1 for s, n in enumerate(self.length)]
        if own_short:
            for state in range(1, len(self.next)):
                found, s = [], state
                while s > 0:
                    found += sorted(own_short.get(s, {}).items())
                    s = self.link[s]
                if found:
                    self.short[state] = found

    def _holder(self, state: int, length: int) -> int:
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _split(self, state: int, word: bytes, target: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        self.link[target] = clone
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            target = self.next[last][word]
            fits = self.length[target] == self.length[last] + 1
            self.link[new] = target if fits else self._split(last, word, target)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of words that are hit, and the items with occurring windows."""
        step, link, length, short = self.next, self.link, self.length, self.short
        window, least = self.window, self.shortest
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = matched = 0
        root = step[0]
        for i, word in enumerate(words):
            to = step[state].get(word) if state else root.get(word)
            if to is None:
                if not state:
                    continue
                while state and to is None:
                    state = link[state]
                    to = step[state].get(word)
                if to is None:
                    matched = 0
                    continue
                matched = length[state]
            state = to
            matched += 1
            if matched < least:
                continue
            if matched >= window:
                items |= self.whole.get(self.window_state[state], ())
                spans.append((i + 1 - window, i + 1))
            for size, found in short.get(state, ()):
                if size <= matched:
                    items |= found
                    spans.append((i + 1 - size, i + 1))
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(bench: DataFrame, window: int, most_words: int = AUTOMATON_WORDS) -> Iterator[SuffixAutomaton]:
    """Automata over all items, each of at most most_words words unless one item alone has more; one is held at a time."""
    group: list[tuple[str, list[bytes]]] = []
    size, made = 0, False
    rows = bench.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    for row in rows.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        words = words_of(row["text"].encode("utf-8", "surrogatepass"))
        if not words:
            continue
        if size and size + len(words) > most_words:
            yield SuffixAutomaton(group, window)
            group, size, made = [], 0, True
        group.append((row["i"], words))
        size += len(words)
    if group or not made:
        yield SuffixAutomaton(group, window)  # of an empty benchmark, one that matches nothing


FOUND = "n_words bigint, spans array<struct<a:int,b:int>>, items array<string>"
SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def scanned(docs: DataFrame, bench: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS, finish=None, finished: str = "") -> DataFrame:
    """docs with n_words, spans (of word positions, merged) and items (ids, sorted as strings); or what `finish`
    makes of each batch of such rows in the same worker, of the schema `finished`.

    One pass without a shuffle; only a benchmark over most_words takes one more
    narrow pass for each further automaton.
    """
    spark = docs.sparkSession
    out = docs
    parts = automata(bench, window, most_words)
    k, automaton = 0, next(parts)
    while automaton is not None:
        shared, automaton = Shared(spark, automaton), next(parts, None)
        last = automaton is None and finish is not None
        first = k == 0
        names = [c for c in out.columns if c not in ("n_words", "spans", "items")] if not first else list(out.columns)
        schema = ", ".join(f"`{c}` {out.schema[c].dataType.simpleString()}" for c in names)

        def run(batches, shared=shared, names=tuple(names), first=first, last=last):
            automaton = shared.get()
            for batch in (part for whole in batches for part in sliced(whole, "text")):
                counts, spans, items = [], [], []
                for n, text in enumerate(texts(batch.column(batch.schema.get_field_index("text")))):
                    words = words_of(text)
                    hit, found = automaton.scan(words)
                    if not first:
                        hit = merged(hit + [(s["a"], s["b"]) for s in batch.column("spans")[n].as_py()])
                        found |= set(batch.column("items")[n].as_py())
                    counts.append(len(words))
                    spans.append([{"a": a, "b": b} for a, b in hit])
                    items.append(sorted(found))
                told = pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(c)) for c in names]
                    + [pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))],
                    [*names, "n_words", "spans", "items"],
                )
                yield finish(told) if last else told

        out = out.mapInArrow(run, finished if last else f"{schema}, {FOUND}")
        k += 1
    return out


def digest(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document with its counts of words, hit words and items."""
    found = scanned(docs.select("doc_id", "text"), bench, window)
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + (s["b"] - s["a"]).cast("bigint"))
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans and what stands between them."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, most_cover: float = 0.8, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """docs without contaminated spans; a document with over most_cover of its words hit goes.

    What is left of a document that is hit has n_chars counted anew; a document
    without hits is returned as it is. One left without any word goes too. Texts
    are cut in the worker that scanned them last.
    """
    inner, names = numbered(docs)
    name_of = dict(zip(docs.columns, names))
    whole = inner.withColumnRenamed(name_of["text"], "text")
    name_of["text"] = "text"
    columns = list(name_of.values())
    kept_schema = "".join(f"`{c}` {whole.schema[c].dataType.simpleString()}, " for c in columns)

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, words = batch.column("spans").to_pylist(), batch.column("n_words").to_pylist()
        hit = [sum(s["b"] - s["a"] for s in own) for own in spans]
        keep = [not h or (h <= n * most_cover and h < n) for h, n in zip(hit, words)]
        column = batch.column(batch.schema.get_field_index("text"))
        if any(k and h for k, h in zip(keep, hit)):
            told = column.to_pylist()
            told = [cut(t, [(s["a"], s["b"]) for s in own]) if k and h else t for t, own, k, h in zip(told, spans, keep, hit)]
            column = pa.array(told, pa.string())
        arrays = [column if c == "text" else batch.column(batch.schema.get_field_index(c)) for c in columns]
        out = pa.RecordBatch.from_arrays([*arrays, pa.array([h > 0 for h in hit], pa.bool_())], [*columns, "hit"])
        return out.filter(pa.array(keep, pa.bool_()))

    left = scanned(whole, bench, window, most_words, finish, f"{kept_schema}hit boolean")
    out = {c: F.col(x) for c, x in name_of.items()}
    if "n_chars" in out:
        counted = F.when(F.col("hit"), F.length("text")).cast(docs.schema["n_chars"].dataType)
        out["n_chars"] = F.when(F.col("hit"), counted).otherwise(out["n_chars"])
    return left.select(*[column.alias(c) for c, column in out.items()])


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()

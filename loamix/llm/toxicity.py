"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams of 3 to 5 characters of its lower
case, hashed to 2**20 places. A place counts by its naive Bayes log-count
ratio, learned from labelled texts, times a weight of a regularised logistic
regression. Only places whose ratio the sample supports take part: by chi-square
at a level of one in the number of places tried, so less than one place in all
is let in by chance, whatever the size of the sample. Near copies in the sample
count once, as they support nothing on their own.

The model is fitted on the driver, on at most PER_CLASS labelled texts of each
class of at most LONGEST characters (documented bounds); scoring reads every
text to its end.

Defined cases: a null or empty text has no features and scores the bias;
without labels of both classes every score is the share of label 1 (0.5
without any); labels other than 0 and 1 are ignored; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamix.llm.common import Shared, fold, sliced
from loamix.llm.sampling import sample
from loamix.llm.shingles import mix, shingle_sets

PER_CLASS = 4000
LONGEST = 40_000
GRAMS = (3, 4, 5)
PLACES = 1 << 20
#: Fewest sample texts that hold a place.
LEAST_TEXTS = 3
#: Bands of two minima over runs of five words that tell near copies in the sample.
BANDS = 4
#: Characters hashed at a time; n-grams across the cut are seen by an overlap.
BLOCK = 1 << 20


def hashes(text: str) -> np.ndarray:
    """Hashed places of all n-grams of the text, framed by one space on each side."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    for n in GRAMS:
        size = len(points) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        for j in range(n):
            h = (h ^ points[j : j + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append((h >> np.uint64(44)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass
class Model:
    weight: np.ndarray  # (PLACES,) ratio times weight, 0 where a place takes no part
    bias: float
    constant: float | None = None

    def scorer(self):
        last = np.zeros(PLACES, np.int64)
        weight = self.weight

        def score(text: str) -> float:
            if self.constant is not None:
                return self.constant
            total = self.bias
            if len(text) <= BLOCK:
                h = hashes(text)
                h = h[weight[h] != 0]
                order = np.arange(len(h))
                last[h] = order  # each distinct place keeps its last position
                total += float(weight[h[last[h] == order]].sum(dtype=np.float64))
            else:
                seen = np.zeros(PLACES, bool)
                for a in range(0, len(text), BLOCK):
                    seen[hashes(text[max(0, a - max(GRAMS)) : a + BLOCK])] = True
                total += float(weight[seen].sum(dtype=np.float64))
            return 1 / (1 + np.exp(-min(40.0, max(-40.0, total))))

        return score


def distinct(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """rows without near copies of an earlier row of the same label."""
    seen, out = set(), []
    for text, label in rows:
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        runs = next(shingle_sets(raw, np.array([0, len(raw)]), 5))
        if len(runs):
            least = [int(mix(runs ^ np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min()) for j in range(1, 2 * BANDS + 1)]
            keys = {(label, b, *least[2 * b : 2 * b + 2]) for b in range(BANDS)}
            if keys & seen:
                continue
            seen |= keys
        out.append((text, label))
    return out


def least_chi(tried: int) -> float:
    """The chi-square (one degree) that one of so many tries exceeds by chance."""
    return NormalDist().inv_cdf(1 - 0.5 / max(2, tried)) ** 2


def fit(rows: list[tuple[str, int]], rounds: int = 300, penalty: float = 2e-3) -> Model:
    rows = distinct(rows)
    y = np.array([int(v) for _, v in rows], np.float64)
    empty = np.zeros(PLACES, np.float32)
    if len(set(y.tolist())) < 2:
        return Model(empty, 0.0, float(y.mean()) if len(y) else 0.5)
    n1, n0 = y.sum(), len(y) - y.sum()
    with1, with0 = np.zeros(PLACES), np.zeros(PLACES)
    for (text, _), label in zip(rows, y):
        (with1 if label else with0)[np.unique(hashes(text))] += 1
    both = with1 + with0
    expected = both * n1 / (n1 + n0)
    chi = (with1 - expected) ** 2 / np.maximum(expected * (n0 / (n1 + n0)) * (1 - both / (n1 + n0)), 1e-9)
    tried = both >= LEAST_TEXTS
    chosen = np.flatnonzero(tried & (chi >= least_chi(int(tried.sum()))))
    ratio = np.log((with1[chosen] + 1) / (n1 + 2)) - np.log((with0[chosen] + 1) / (n0 + 2))
    number = np.full(PLACES, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    index, owner = [], []
    for i, (text, _) in enumerate(rows):  # hashed again, as all sets at once would take too much memory
        f = number[hashes(text)]
        f = np.unique(f[f >= 0])
        index.append(f)
        owner.append(np.full(len(f), i, np.int32))
    index, owner = np.concatenate(index), np.concatenate(owner)
    x = ratio[index]
    balance = np.where(y == 1, 0.5 / (n1 / len(y)), 0.5 / (n0 / len(y)))
    w, b = np.full(len(chosen), 0.05), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(owner, x * w[index], minlength=len(y)) + b
        slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance / len(y)
        g = np.bincount(index, x * slope[owner], minlength=len(w)) + penalty * w / max(1, len(w)) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        gb = slope.sum()
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - 0.02 * (m / c1) / (np.sqrt(v / c2) + 1e-10)
        b -= 0.02 * (mb / c1) / (np.sqrt(vb / c2) + 1e-10)
    weight = empty
    weight[chosen] = (w * ratio).astype(np.float32)
    return Model(weight, float(b))


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int = LONGEST) -> Model:
    own = labels.filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id"), 5) != 0))
    return fit(sample(own.select("doc_id", F.col("toxic").cast("int").alias("label")), docs, per_class, longest))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document; one narrow pass."""
    shared = Shared(docs.sparkSession, model)

    def run(batches):
        score = shared.get().scorer()
        for batch in batches:
            for part in sliced(batch, "text"):
                values = [score(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, trained(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

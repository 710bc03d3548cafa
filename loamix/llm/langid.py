"""Language identification by the nearest of several centroids per language.

A text becomes a vector of its character n-grams (1 to 3 characters, digits
and marks as spaces) hashed to DIMS places, with logarithmic counts times
inverse document frequencies, of length one. Each language has a few centroids
from spherical k-means over labelled texts. The language of the centroid with
the largest cosine wins. A text farther from it than nearly all of that
centroid's own training texts is marked as rejected: it keeps its nearest
language, and its score is scaled down by how far outside it lies.

The model is fitted on at most PER_LANG texts of each language of at most
LONGEST characters (documented bounds); prediction reads every text to its end.

Defined cases: a null text, or one without a letter, is `und` with score 0; a
letter is a character of a Unicode letter category; without training texts
every row is `und`; ties between languages fall to the first in order; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamix.llm.common import Shared, fold, sliced
from loamix.llm.sampling import sample

PER_LANG = 500
LONGEST = 8000
DIMS = 4096
CENTROIDS = 4
BLOCK = 1 << 20
NOT_LETTERS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of the text."""
    out = np.zeros(DIMS, np.int64)
    for a in range(0, max(1, len(text)), BLOCK):
        part = f" {NOT_LETTERS.sub(' ', text[a : a + BLOCK].lower()).strip()} "
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(points), np.uint32)
        for n in (1, 2, 3):
            size = len(points) - n + 1
            if size <= 0:
                break
            h = (h[:size] ^ points[n - 1 :]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            out += np.bincount((h * np.uint32(0x85EBCA6B)) >> np.uint32(20), minlength=DIMS)
    return out


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray  # (n, DIMS)
    langs: list[str]  # of each centroid
    radius: np.ndarray  # least cosine of each centroid's own texts

    def vector(self, text: str) -> np.ndarray:
        v = np.log1p(counts(text)).astype(np.float32) * self.idf
        return v / max(float(np.linalg.norm(v)), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in 0..1, and whether the text lies outside of what the model has seen."""
        if text is None or not len(self.centroids) or not has_letter(text):
            return "und", 0.0, False
        cosines = self.centroids @ self.vector(text)
        best = int(cosines.argmax())
        cosine = min(1.0, max(0.0, float(cosines[best])))
        outside = bool(cosine < self.radius[best])
        return self.langs[best], cosine * (cosine / float(self.radius[best]) if outside else 1.0), outside


def clusters(vectors: np.ndarray, k: int, seed: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with k-means++ seeding: centroids and each vector's centroid."""
    rng = np.random.default_rng(seed)
    centres = vectors[[int(rng.integers(len(vectors)))]]
    while len(centres) < min(k, len(vectors)):
        far = np.maximum(1 - (vectors @ centres.T).max(axis=1), 0) ** 2
        if far.sum() <= 1e-12:
            break
        centres = np.vstack([centres, vectors[[int(rng.choice(len(vectors), p=far / far.sum()))]]])
    near = (vectors @ centres.T).argmax(axis=1)
    for _ in range(rounds):
        for c in range(len(centres)):
            if (own := vectors[near == c]).size:
                mean = own.mean(axis=0)
                centres[c] = mean / max(float(np.linalg.norm(mean)), 1e-12)
        near = (vectors @ centres.T).argmax(axis=1)
    return centres, near


def fit(rows: list[tuple[str, str]], k: int = CENTROIDS, seed: int = 11) -> Model:
    rows = [(t, lang) for t, lang in rows if has_letter(t)]
    if not rows:
        return Model(np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    tf = np.log1p(np.array([counts(t) for t, _ in rows])).astype(np.float32)
    df = (tf > 0).sum(axis=0)
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    vectors = tf * idf
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    langs = np.array([lang for _, lang in rows])
    all_centres, names, radius = [], [], []
    for lang in sorted(set(langs.tolist())):
        own = vectors[langs == lang]
        centres, near = clusters(own, k, seed)
        for c in range(len(centres)):
            mine = own[near == c]
            if len(mine):
                all_centres.append(centres[c])
                names.append(lang)
                radius.append(max(1e-6, float(np.quantile(mine @ centres[c], 0.01))))
    return Model(idf, np.array(all_centres, np.float32), names, np.array(radius))


def trained(docs: DataFrame, per_lang: int = PER_LANG, longest: int = LONGEST) -> Model:
    """Fitted on documents with a language, of folds 1 to 4 of 5."""
    own = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    return fit(sample(own.select("doc_id", F.col("lang").alias("label")), docs, per_lang, longest))


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every document; one narrow pass."""
    shared = Shared(docs.sparkSession, model)

    def run(batches):
        own = shared.get()
        for batch in batches:
            for part in sliced(batch, "text"):
                langs, scores, outside = zip(*[own.predict(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(outside, pa.bool_())],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def digest(docs: DataFrame) -> DataFrame:
    out = predicted(docs, trained(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")

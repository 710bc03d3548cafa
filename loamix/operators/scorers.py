"""Stand-ins for models and extractors: deterministic, offline, and open to replacement.

Each is a plain function from texts to values; `column` turns any function of
that shape, also one that calls a model, into a vectorised column.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")


def column(fn: Callable, kind: str) -> Callable[..., Column]:
    """A pandas UDF that applies fn to the values of each row."""

    @F.pandas_udf(kind)
    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series([fn(*row) for row in zip(*columns)])

    return apply


def batched(fn: Callable, kind: str) -> Callable[..., Column]:
    """A pandas UDF that gives fn each distinct tuple of values of a batch once, as a model call would cost much more than a look-up."""

    @F.pandas_udf(kind)
    def apply(*columns: pd.Series) -> pd.Series:
        rows = list(zip(*columns))
        known = {row: fn(*row) for row in dict.fromkeys(rows)}
        return pd.Series([known[row] for row in rows])

    return apply


def embed(text: str | None, size: int = 64) -> list[float]:
    """Hashed word counts of length one."""
    out = [0.0] * size
    for word in WORD.findall((text or "").lower()):
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        out[h % size] += 1.0 if h >> 63 else -1.0
    length = math.sqrt(sum(x * x for x in out))
    return [x / length for x in out] if length else out


def pair_score(query: str | None, text: str | None) -> float:
    """Share of the question's words in the text, on the scale of a cross-encoder."""
    asked = set(WORD.findall((query or "").lower()))
    found = asked & set(WORD.findall((text or "").lower()))
    return 16.0 * len(found) / len(asked) - 8.0 if asked else -8.0


def statements(text: str | None) -> str:
    """A numbered list of the text's sentences."""
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", (text or "")[:2000]) if len(s.strip()) >= 10]
    return "\n".join(f"{i}. {s}" for i, s in enumerate(parts, 1))


def summarise(text: str | None, most: int = 300) -> str:
    first = re.split(r"(?<=[.!?])\s+", (text or "").strip())[0] if text else ""
    return first[:most]


def grade(query: str | None, text: str | None) -> str:
    score = pair_score(query, text)
    return "YES" if score > 0 else "PARTIAL" if score > -6 else "NO"


def gestalt_ratio(a: str | None, b: str | None) -> float:
    """Likeness of two short lines by their longest common blocks."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a or "", b or "").ratio()

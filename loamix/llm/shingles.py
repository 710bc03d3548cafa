"""Distinct word shingles of texts as 64-bit hashes, many texts at a time in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z in
lower case. A word's hash is a polynomial in an odd base over random values of
its bytes, modulo 2**64; prefix sums give the hashes of all words at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from loamix.llm.common import LOWER

_RNG = np.random.default_rng(20240229)
#: A random value for each byte, with A-Z as a-z.
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)[np.frombuffer(LOWER, np.uint8)]
IS_SPACE = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])
BASE = 0x9E3779B97F4A7C15 | 5
UNBASE = pow(BASE, -1, 1 << 64)
#: Bytes hashed at a time.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were asked for; kept while a task runs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            ups, downs = np.full(size, BASE, np.uint64), np.full(size, UNBASE, np.uint64)
            ups[0] = downs[0] = 1
            self.up, self.down = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
        return self.up, self.down


POWERS = Powers()


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts raw[at[i]:at[i + 1]], in order, and the number of words of each text."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    solid = ~IS_SPACE[raw]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0] = last[-1] = True
    first[1:], last[:-1] = ~solid[:-1], ~solid[1:]
    inner = at[(at > 0) & (at < n)]
    first[inner], last[inner - 1] = True, True
    starts, ends = np.flatnonzero(solid & first), np.flatnonzero(solid & last) + 1
    up, down = POWERS.get(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    cuts = np.searchsorted(starts, at)
    return hashes, np.diff(cuts)


def pieces(raw: np.ndarray) -> list[np.ndarray]:
    """A long text in pieces of about BLOCK bytes that end at white space, so that no word is cut."""
    out, at = [], 0
    while len(raw) - at > BLOCK:
        end, step = at + BLOCK, 4096
        while end < len(raw) and not (space := np.flatnonzero(IS_SPACE[raw[end : end + step]])).size:
            end += step
        end = min(len(raw), end + int(space[0])) if end < len(raw) else len(raw)
        out.append(raw[at:end])
        at = end
    return [*out, raw[at:]]


def words_by_text(raw: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's word hashes, hashed in blocks of about BLOCK bytes."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        if at[j] - at[i] > BLOCK:
            parts = pieces(raw[at[i] : at[j]])
            yield np.concatenate([word_hashes(p, np.array([0, len(p)]))[0] for p in parts])
        else:
            hashes, counts = word_hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            ends = np.cumsum(counts)
            for a, b in zip((ends - counts).tolist(), ends.tolist()):
                yield hashes[a:b]
        i = j


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; fewer words make one run; no words, none."""
    if not len(words):
        return words
    size = min(k, len(words))
    runs = words[: len(words) - size + 1].copy()
    for j in range(1, size):
        runs = runs * np.uint64(0xD1342543DE82EF95) + words[j : len(words) - size + 1 + j]
    return np.unique(mix(runs + np.uint64(size)))


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    for words in words_by_text(raw, at):
        yield shingle_set(words, k)

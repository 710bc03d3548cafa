"""Lexical retrieval packing: windows filled with BM25 neighbours from a sharded inverted index.

Documents become token ids. Shards of a bounded number of tokens are cut from
an order that puts lexically close documents side by side. Each shard builds an
inverted index over its documents' ids, with document frequencies and the mean
length of the whole corpus, and fills windows of `width` ids one by one: a seed
document, then its best unused neighbours by BM25. A document that doesn't fit
is cut, and its rest seeds the next window. What is left at a shard's end is
cut into powers of two, which need no padding.

Defined cases: a null or empty text has the end id alone; rows that share a
doc_id are packed singly; ties in score fall to the earlier document of the
shard; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import os
import re
import sys
import types
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamix.llm.common import Shared, drop_stored, sliced, stored
from loamix.llm.shingles import mix

WIDTH = 2048
END = 1
#: Tokens in one shard of the index.
SHARD_TOKENS = 2_000_000
#: A term that at least one in so many of a shard's documents hold keeps a weight for each document, any other term keeps postings.
DENSE_SHARE = 4
K1, B = 1.5, 0.75
#: Distinct parts of words whose ids a worker remembers in one of two generations, about 200 bytes each; let go once they are packed.
REMEMBERED = 600_000
#: Texts of these characters alone, all of Latin-1, are cut into parts before those are looked up;
#: any other text is encoded as a whole. Both give the same ids.
PLAIN = re.compile("[\t\n\r\x20-\x3b=-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]*")
#: How the tokenizer cuts such a text, lower-cased, before it merges (fixed values, for these characters): at white space, around
#: runs of letters and of marks, and around each digit. An apostrophe alone takes the letters of these endings along.
SPACE, LETTER, DIGIT, MARK = range(4)
KIND = np.array([SPACE if chr(b) in "\t\n\r " else DIGIT if 48 <= b <= 57 else LETTER if 97 <= b <= 122 or b >= 223 and b != 247 else MARK for b in range(256)], np.uint8)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LATIN_LOWER = bytes(ord(chr(b).lower()) for b in range(256))
#: The letters that stand for bytes which print nothing in byte-level vocabularies: 256 and up, in order.
BYTE_LETTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Known(dict):
    """Ids of parts of words as bytes; a new part is merged when it is first asked for. Two generations are kept."""

    def __init__(self, merge):
        super().__init__()
        self.merge, self.before = merge, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part)
        if ids is None:
            letters = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = packed_ids([t.id for t in self.merge(letters)])
        self[part] = ids
        return ids

    def turn(self) -> None:
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()


def part_starts(raw: np.ndarray) -> np.ndarray:
    """Whether a part of a word, or white space, begins at each of the lower-cased Latin-1 characters."""
    kind = KIND[raw]
    first = np.ones(len(raw), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    at = np.flatnonzero(raw == ord("'"))
    if len(at):
        beside = np.pad(raw, (1, 3), constant_values=ord(" "))
        at = at[(KIND[beside[at]] != MARK) & (KIND[beside[at + 2]] != MARK)]
        for ending in ENDINGS:
            has = at[np.logical_and.reduce([beside[at + 2 + i] == ord(c) for i, c in enumerate(ending)])]
            first[has + 1] = False
            after = has + 1 + len(ending)
            first[after[after < len(raw)]] = True
    return first


def packed_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if NATIVE else np.asarray(ids, "<u4").tobytes()


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, never joins across white space and cuts words
    into runs of letters, single digits and runs of marks before it merges. So
    the ids of a plain text are those of such parts one after the other, which
    repeat far more often than words and are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(self.tokenizer.model.tokenize)
        self.by_parts = self.cuts_as_known()

    def cuts_as_known(self) -> bool:
        """Whether the tokenizer cuts a sample of plain text as `part_starts` does, lower-cased and without joining across white space."""
        sample = "It's THE 1st e-mail (of 23): we'll go!? Ça été\tÜber--naïve\nx.y_z 'tis don'T ''s they're'd"
        try:
            return self.of_parts([sample])[0].tolist() == self.tokenizer.encode(sample, add_special_tokens=False).ids
        except Exception:  # a model that can't be asked for one part
            return False

    def of_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`stream` of plain texts. Equal parts are looked up once; their ids are then dealt out to the places where they stand."""
        coded = [t.encode("latin-1") for t in texts]
        raw = np.frombuffer(b"\n".join(coded).translate(LATIN_LOWER), np.uint8)
        begin = np.cumsum([0] + [len(c) + 1 for c in coded])
        first, solid = part_starts(raw), KIND[raw] != SPACE
        letters = raw[solid]
        cuts = np.append(np.flatnonzero(first[solid]), len(letters))
        parts = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(letters)]).dictionary_encode()
        _, at, distinct = parts.dictionary.buffers()
        own = distinct.to_pybytes().decode("latin-1") if distinct else ""
        at = np.frombuffer(at, np.int64)[: len(parts.dictionary) + 1].tolist()
        found = [self.known[own[a:b]] for a, b in zip(at, at[1:])]
        ids = np.frombuffer(b"".join(found), "<u4")
        counts = np.array([len(f) for f in found], np.int64) // 4
        codes = parts.indices.to_numpy()
        each = counts[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        whole = ids[np.repeat((np.cumsum(counts) - counts)[codes] - ends[:-1], each) + np.arange(ends[-1])]
        return whole, np.diff(ends[np.searchsorted(np.flatnonzero(first & solid), begin)])

    def stream(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        self.known.turn()
        plain = [self.by_parts and PLAIN.fullmatch(t) is not None for t in texts]
        whole, sizes = self.of_parts([t if p else "" for t, p in zip(texts, plain)])
        if all(plain):
            return whole, sizes
        parts = np.split(whole, np.cumsum(sizes)[:-1])
        parts = [x if p else np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") for x, t, p in zip(parts, texts, plain)]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids."""
        if not texts:
            return []
        ids, sizes = self.stream(texts)
        return [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def vocabulary_of(path: str) -> int:
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    if size > 1 << 16:
        raise ValueError(f"ids are held in 16 bits; {path} has {size}")
    return size


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker: it outlives a task, and with it the words it knows."""
    state = sys.modules.setdefault("loamix_worker_state", types.ModuleType("loamix_worker_state"))
    if getattr(state, "path", None) != path:
        state.path, state.encoder = path, Encoder(path)
    return state.encoder


def forget_encoder() -> None:
    sys.modules.pop("loamix_worker_state", None)


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (16 bits each, end id included), n and place (a hash that near texts are likely to share)."""

    def run(batches):
        encoder = worker_encoder(tokenizer)
        for batch in (part for whole in batches for part in sliced(whole, "text")):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            raw, sizes = encoder.stream(texts)
            tokens = np.insert(raw, np.cumsum(sizes), END).astype("<u2")
            at = np.concatenate([[0], np.cumsum(sizes + 1)])
            ids = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(2 * at), pa.py_buffer(tokens)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array(sizes + 1), pa.array(places_of(tokens, at))],
                ["doc_id", "ids", "n", "place"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, n bigint, place bigint")


def place_of(tokens: np.ndarray) -> int:
    """Least hash over the text's runs of four ids."""
    x = tokens.astype(np.uint64)
    if len(x) < 4:
        return int(mix(x + np.uint64(1)).min().view(np.int64))
    runs = x[:-3] << np.uint64(48) | x[1:-2] << np.uint64(32) | x[2:-1] << np.uint64(16) | x[3:]
    return int(mix(runs).min().view(np.int64))


def places_of(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`place_of` of each text; the texts' tokens stand one after the other, at[i] to at[i + 1]."""
    x = tokens.astype(np.uint64)
    start, end = at[:-1], at[1:]
    out = np.zeros(len(start), np.int64)
    long = end - start >= 4
    if long.any():
        runs = mix(x[:-3] << np.uint64(48) | x[1:-2] << np.uint64(32) | x[2:-1] << np.uint64(16) | x[3:])
        spans = np.stack([start[long], end[long] - 3], 1).ravel()  # every other span is that between two texts
        out[long] = np.minimum.reduceat(np.append(runs, np.uint64(0)), spans)[::2].view(np.int64)
    for i in np.flatnonzero(~long).tolist():
        out[i] = place_of(tokens[start[i] : end[i]])
    return out


def document_frequencies(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """In how many documents each id occurs, over all documents; one number per id of the vocabulary."""

    def run(batches):
        counts, seen = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, bool)
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                seen[np.frombuffer(raw, "<u2")] = True
                own = np.flatnonzero(seen)
                counts[own] += 1
                seen[own] = False
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(counts[at])], ["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


class Shard:
    """Inverted index of some documents, and the windows filled from it."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.docs, self.idf = docs, idf
        terms, owners, counts = [], [], []
        for i, d in enumerate(docs):
            t, c = np.unique(d, return_counts=True)
            terms.append(t)
            counts.append(c)
            owners.append(np.full(len(t), i, np.int32))
        self.own = [(t, c) for t, c in zip(terms, counts)]
        term, owner, count = np.concatenate(terms), np.concatenate(owners), np.concatenate(counts)
        length = np.array([len(d) for d in docs], np.float32)[owner]
        order = np.argsort(term, kind="stable")
        self.start = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.owner = owner[order]
        weight = count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean)) * idf[term]
        self.weight = weight[order].astype(np.float32)
        common = np.flatnonzero(DENSE_SHARE * np.diff(self.start) >= len(docs))
        self.dense = np.zeros((len(common), len(docs)), np.float32)
        self.row = np.full(len(idf), -1, np.int64)
        self.row[common] = np.arange(len(common))
        for i, term in enumerate(common.tolist()):
            a, b = self.start[term], self.start[term + 1]
            self.dense[i, self.owner[a:b]] = self.weight[a:b]
        self.scored: tuple[int, np.ndarray] | None = None

    def scores(self, seed: int) -> np.ndarray:
        """Each document's BM25 for all distinct terms of the seed; the end id, which all documents hold, is no term."""
        if self.scored is None or self.scored[0] != seed:  # a long document seeds several windows in a row
            terms = self.own[seed][0]
            terms = terms[terms != END]
            rows = self.row[terms]
            score = np.zeros(len(self.docs), np.float64)
            for row in rows[rows >= 0].tolist():
                score += self.dense[row]
            rare = terms[rows < 0].astype(np.int64)
            if len(rare):
                spans = [slice(a, b) for a, b in zip(self.start[rare].tolist(), self.start[rare + 1].tolist())]
                owners, weights = np.concatenate([self.owner[x] for x in spans]), np.concatenate([self.weight[x] for x in spans])
                score += np.bincount(owners, weights, len(self.docs))
            self.scored = seed, score
        return self.scored[1]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first."""
        score = np.where(unused, self.scores(seed), 0)
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]

    def windows(self, width: int) -> list[list[tuple[int, int, int]]]:
        """Each window's pieces (document, start, length)."""
        sizes = [len(d) for d in self.docs]
        unused = np.ones(len(sizes), bool)
        done, window, room = [], [], width
        order, at, ranked, seed = iter(range(len(sizes))), 0, np.zeros(0, np.int64), None

        def following() -> int | None:
            nonlocal at
            while at < len(ranked):
                at += 1
                if unused[ranked[at - 1]]:
                    return int(ranked[at - 1])
            return next((i for i in order if unused[i]), None)

        while (doc := following()) is not None:
            unused[doc] = False
            if seed is None:
                seed, ranked, at = doc, self.neighbours(doc, unused), 0
            start = 0
            while start < sizes[doc]:
                size = min(room, sizes[doc] - start)
                window.append((doc, start, size))
                start, room = start + size, room - size
                if not room:
                    done.append(window)
                    window, room, seed = [], width, None
                    ranked, at = np.zeros(0, np.int64), 0
            if window and seed is None:  # the rest of a cut document seeds the next window
                seed, ranked, at = doc, self.neighbours(doc, unused), 0
        return done + powers_of_two(window)


def powers_of_two(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A partly filled window as windows whose sizes are powers of two."""
    left, out = sum(n for _, _, n in window), []
    pieces = list(reversed(window))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        part = []
        while room:
            doc, start, n = pieces.pop()
            size = min(n, room)
            part.append((doc, start, size))
            room -= size
            if size < n:
                pieces.append((doc, start + size, n - size))
        out.append(part)
    return out


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def packed(docs: DataFrame, tokenizer: str | None = None, width: int = WIDTH, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the piece's ids (unsigned 16-bit bytes).

    The token table is written once; shards are ranges of (place, doc_id), so
    a place that very many documents share is cut between shards. A task holds
    one shard of at most shard_tokens tokens, or one longer document, at a time.
    """
    tokenizer = tokenizer or default_tokenizer()
    vocabulary = max(END + 1, vocabulary_of(tokenizer))
    tokens, tokens_path = stored(tokenized(docs, tokenizer), "tokens")
    spark = docs.sparkSession
    total = tokens.agg(F.count("*").alias("docs"), F.sum("n").alias("n")).first()
    df = document_frequencies(tokens, vocabulary)
    n_docs = max(1, total["docs"])
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = Shared(spark, (idf, (total["n"] or 1) / n_docs))
    shards = max(1, -(-(total["n"] or 0) // shard_tokens))
    ranged = tokens.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(shards, "place", "doc_id", "at")
    ranged = ranged.sortWithinPartitions("place", "doc_id", "at").withColumn("task", F.spark_partition_id().cast("bigint"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows_of(ids, docs_, windows, first):
        columns = [[] for _ in range(8)]
        for k, window in enumerate(windows):
            offset = 0
            for doc, start, size in window:
                part = docs_[doc][start : start + size]
                values = (ids[doc], start, size, zlib.crc32(part.astype("<u4").tobytes()), len(docs_[doc]), first + k, offset, part.tobytes())
                for column, value in zip(columns, values):
                    column.append(value)
                offset += size
        return columns

    def run(batches):
        forget_encoder()
        idf_, mean = shared.get()
        ids, held, size, first, kind_ = [], [], 0, None, None

        def flush():
            nonlocal ids, held, size, first
            windows = Shard(held, idf_, mean).windows(width)
            columns = rows_of(ids, held, windows, first)
            first += len(windows)
            ids, held, size = [], [], 0
            for a in range(0, len(columns[0]), 20_000):
                arrays = [pa.array(columns[0][a : a + 20_000], kind_)] + [pa.array(c[a : a + 20_000], pa.int64()) for c in columns[1:7]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    arrays.append(pa.array(columns[7][a : a + 20_000], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            kind_ = batch.schema.field("doc_id").type
            if batch.num_rows and first is None:
                first = batch.column("task")[0].as_py() << 40
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                tokens_ = np.frombuffer(raw, "<u2")
                if held and size + len(tokens_) > shard_tokens:
                    yield from flush()
                ids.append(doc)
                held.append(tokens_)
                size += len(tokens_)
        if held:
            yield from flush()

    schema = f"doc_id {kind}, {PIECES}" + (", ids binary" if with_ids else "")
    # the ranges are drawn from a sample of each run's own, so the pieces are written once
    out, _ = stored(ranged.select("doc_id", "ids", "task").mapInArrow(run, schema), "pieces")
    drop_stored(spark, tokens_path)
    return out


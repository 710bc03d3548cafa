import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loamix.llm import packing as P

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
PLAIN = tokenizers.Tokenizer.from_file(P.default_tokenizer())
OWN = P.Encoder(P.default_tokenizer())


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, P.END]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="abcÄß é'st 12.,<|endoftext|>\n!?ñ²", max_size=40)), max_size=5))
def test_encoder_gives_the_tokenizers_ids(texts):
    for text, raw in zip(texts, OWN.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet="'strevmld1!\xe9\xd7\xf7\xdf \n", max_size=25), min_size=1, max_size=4))
def test_endings_after_apostrophes(texts):
    assert OWN.by_parts
    for text, raw in zip(texts, OWN.encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


def test_places_of_many_texts():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 9, n).astype("<u2") for n in [*range(1, 9), 400, 3, 2, 50, 4]]
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    assert P.places_of(np.concatenate(docs), at).tolist() == [P.place_of(d) for d in docs]
    assert P.places_of(docs[0], np.array([0, 1])).tolist() == [P.place_of(docs[0])] and len(P.places_of(docs[0][:0], np.array([0]))) == 0


def test_pieces(spark):
    texts = [f"Some words of document {i} " * (i % 40) for i in range(150)] + [None, "", "same", "same", "long words here " * 4000]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = P.packed(docs, shard_tokens=20_000, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, parts in by_doc.items():
        ids = ids_of(texts[i])
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            own = np.array(ids[at : at + r["length"]], "<u4")
            assert zlib.crc32(own.tobytes()) == r["ids_crc32"] and np.frombuffer(r["ids"], "<u2").tolist() == own.tolist()
            at += r["length"]
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert P.packed(docs.limit(0)).count() == 0


def test_neighbours_share_words():
    docs = [np.array([5, 6, 7, 8, i + 100], np.uint16) if i % 2 else np.array([15, 16, 17, 18, i + 100], np.uint16) for i in range(12)]
    shard = P.Shard(docs, np.ones(1 << 16, np.float32), 5.0)
    unused = np.ones(12, bool)
    unused[[1, 3]] = False
    assert shard.neighbours(1, unused).tolist() == [5, 7, 9, 11]
    windows = shard.windows(10)
    assert all(len({d % 2 for d, _, _ in w}) == 1 for w in windows)


def test_all_terms_of_the_seed_count():
    rng = np.random.default_rng(3)
    # the seed's 30 rare ids stand in no other document; the common ones decide
    docs = [np.concatenate([np.arange(1000, 1030), np.arange(10, 40), [P.END]]).astype(np.uint16)]
    docs += [np.concatenate([rng.choice(np.arange(10, 80), 25), [2000 + i, P.END]]).astype(np.uint16) for i in range(60)]
    docs += [np.array([3000, P.END], np.uint16)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16)
    idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = sum(map(len, docs)) / len(docs)

    def bm25(d):
        of = {t: (d == t).sum() for t in set(docs[0].tolist()) - {P.END}}
        return sum(idf[t] * c * (P.K1 + 1) / (c + P.K1 * (1 - P.B + P.B * len(d) / mean)) for t, c in of.items())

    unused = np.ones(len(docs), bool)
    unused[0] = False
    want = [bm25(d) for d in docs]
    shard = P.Shard(docs, idf, mean)
    found = shard.neighbours(0, unused).tolist()
    assert sorted(found) == list(range(1, 61))
    assert np.allclose([want[i] for i in found], sorted(want[1:61], reverse=True), rtol=1e-5)
    assert np.allclose(shard.scores(0), want, rtol=1e-5)


def test_powers_of_two():
    windows = P.powers_of_two([(0, 3, 100), (1, 0, 7), (2, 0, 1)])
    assert [sum(n for _, _, n in w) for w in windows] == [64, 32, 8, 4]
    assert [p for w in windows for p in w] == [(0, 3, 64), (0, 67, 32), (0, 99, 4), (1, 0, 4), (1, 4, 3), (2, 0, 1)]

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loamix.llm import minhash as M
from loamix.llm import shingles as S
from loamix.llm.components import stars


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k):
    sets = [(i, shingle_set(t, k)) for i, t in docs]
    home = {i: i for i, _ in docs}

    def find(x):
        while home[x] != x:
            x = home[x]
        return x

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                home[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in docs}


def near_copies(seed, n, vocabulary, size, edits):
    rng = random.Random(seed)
    base = [rng.choice(vocabulary) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def cases():
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for seed, (n, size, edits) in enumerate([(60, 60, 12), (40, 30, 5), (12, 8, 2), (5, 200, 30), (80, 25, 6)]):
        texts += near_copies(seed, n, vocabulary, size, edits)
    texts += ["Same words HERE", "same  words\there", "one", "ONE", "", None, "  ", "two words", "ü ä", "ü ä"]
    random.Random(9).shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_components_against_brute_force(spark):
    docs = cases()
    frame = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, n int, component string")
    for k in (2, 5):
        out = {r["doc_id"]: r for r in M.digest(frame, k).collect()}
        want = brute(docs, k)
        assert {i: r["component_id"] for i, r in out.items()} == want
        assert all(r["n_shingles"] == len(shingle_set(dict(docs)[i], k)) and r["kept"] == (i == want[i]) for i, r in out.items())
    kept = {r["doc_id"] for r in M.deduped(frame).collect()}
    assert kept == {i for i, c in brute(docs, 5).items() if i == c}


def test_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (3, None), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in M.digest(frame, 2).collect()), key=str)
    assert out == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True)], key=str)
    assert M.digest(frame.limit(0), 2).count() == 0


def test_one_row_of_a_repeated_doc_id_stays(spark):
    rows = [(1, "a b c", 5, {"k": 1}), (1, "a b c", 4, {"k": 2}), (2, "a b c", 6, None), (None, "a b c", 7, None), (None, "a b c", 8, None)]
    rows += [(3, None, 1, None), (3, "x y z", 2, None), (3, "other words", 3, None), (4, "", 1, None), (4, "", 1, None), (9, "alone here", 1, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, one int, extra map<string, int>")
    out = M.deduped(frame)
    assert out.columns == frame.columns
    got = sorted(((r["doc_id"], r["text"], r["one"], r["extra"]) for r in out.collect()), key=str)
    want = [(1, "a b c", 4, {"k": 2}), (None, "a b c", 7, None), (None, "a b c", 8, None), (3, "other words", 3, None), (4, "", 1, None), (9, "alone here", 1, None)]
    assert got == sorted(want, key=str)


def test_stars(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {r["a"]: r["b"] for r in stars(spark.createDataFrame(edges, "a long, b long"))[0].collect()}
    home = {}

    def find(x):
        while home.setdefault(x, x) != x:
            x = home[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        home[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in home if find(x) != x}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \n\tü.", max_size=40), max_size=6))
def test_words_are_told_apart(texts):
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    found = list(S.words_by_text(np.frombuffer(b"".join(raw), np.uint8), at))
    seen = {}
    for t, hashes in zip(texts, found):
        assert len(words(t)) == len(hashes)
        for w, h in zip(words(t), hashes.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(4000)).encode()
    at = np.array([0, len(text)])
    whole = next(S.words_by_text(np.frombuffer(text, np.uint8), at)).tolist()
    monkeypatch.setattr(S, "BLOCK", 100)
    assert next(S.words_by_text(np.frombuffer(text, np.uint8), at)).tolist() == whole


def test_columns_of_any_name_and_repeated_ids(spark):
    rows = [(1, "one two three four five six", "p"), (1, "one two three four five six", "q"), (1, None, "r"), (2, "one two three four five six", "s"), (None, "one two three four five six", "t"), (3, "", "u")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, `a.b` string, n int, component long")
    out = M.deduped(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["a.b"], r["n"]) for r in out.collect()) == [("1", "p", 7), ("3", "u", 7), ("None", "t", 7)]

import hashlib
import re

from loamix.llm import spotsigs as S


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def signature_set(text):
    stop, out = set(S.anchor_words()), set()
    tokens = [S.START, *words(text)]
    content = [i for i, w in enumerate(tokens) if i and w not in stop]
    for n, i in enumerate(content):
        if tokens[i - 1] in stop or i == 1:
            following = tokens[content[n + 1]] if n + 1 < len(content) else S.END
            out.add(hashlib.md5(f"{tokens[i - 1]} {tokens[i]} {following}".encode()).hexdigest()[:8])
    return out


def likeness(x, y):
    a, b = signature_set(x), signature_set(y)
    return len(a & b) / len(a | b) if a | b else float(x == y)


TEXTS = [
    "The cat of the house and the dog", "the cat of the House, and the dog!", "A bird in the tree is the king of all birds. " * 30, "", None, "!!!", "???", "and the of",
    "die die die die haus " * 500, "Über die Brücke in der Stadt", "one", "x" * 9001, "the a the a b",
]


def rows_of(n=60):
    out = [(i, TEXTS[i % len(TEXTS)] if i % 4 else f"{TEXTS[i % len(TEXTS)]} extra the word{i}") for i in range(n)]
    return [*out, (None, "the null row"), (7, TEXTS[3]), (7, TEXTS[3])]


def test_against_brute_force(spark, monkeypatch):
    rows = rows_of()
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, s int")
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(r[0] if r[0] is not None else S.NO_ID), r[1]))
    want = []
    for n, (i, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        digest = lambda x: "".join(sorted(signature_set(x)))
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), digest(t), digest(edited), round(likeness(t, edited), 9), round(likeness(t, nxt), 9)))
    for stretch in (20_000, 7, 1):
        monkeypatch.setattr(S, "STRETCH", stretch)
        got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in S.compared(frame).collect()]
        assert sorted(got) == sorted(want)
    assert S.compared(frame.limit(0)).count() == 0
    alone = S.compared(frame.filter("doc_id = 2")).first()
    assert alone["near_next"] == 1.0


def test_many_stretches_find_their_bound(spark):
    bounds = list(range(0, 9000, 3))
    frame = spark.range(0, 9000, 37).select("id", S.stretch_of(bounds, __import__("pyspark").sql.functions.col("id")).alias("s"))
    assert all(r["s"] == sum(b <= r["id"] for b in bounds) for r in frame.collect())


def test_near_pairs(spark):
    base = "the river of the valley and the road to the north with a bridge in the middle for the people on the way by the sea "
    texts = [f"{base} {' '.join(f'the item{j} of' for j in range(i % 9))} in the end{i % 3}" for i in range(40)] + [base, base.upper(), "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["a"], r["b"]): round(r["likeness"], 9) for r in S.near_pairs(frame, 0.7).collect()}
    reps = {r["rep"]: r["size"] for r in S.classes(frame).collect()}
    want = {(a, b): round(likeness(texts[a], texts[b]), 9) for a in reps for b in reps if a < b and likeness(texts[a], texts[b]) >= 0.7}
    assert got == want and want
    assert sum(reps.values()) == 42

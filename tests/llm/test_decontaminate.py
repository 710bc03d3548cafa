import random

from loamix.llm import decontaminate as D


def brute(text, items, window=10):
    words = D.words_of((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        ws = D.words_of((t or "").encode())
        size = min(window, len(ws))
        for i in range(len(ws) - size + 1) if ws else ():
            for j in range(len(words) - size + 1):
                if words[j : j + size] == ws[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for case in range(150):
        letters = "abc"[: rng.randint(1, 3)]
        items = [(i, " ".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 9, 10, 11, 25])))) for i in range(rng.randint(1, 5))]
        auto = D.SuffixAutomaton([(str(i), D.words_of(t.encode())) for i, t in items if t], 10 if case % 2 else 4)
        text = " ".join(rng.choices(letters + "z", weights=[9] * len(letters) + [1], k=rng.randint(0, 60)))
        spans, found = auto.scan(D.words_of(text.encode()))
        n, hit, want = brute(text, items, 10 if case % 2 else 4)
        assert sum(b - a for a, b in spans) == hit and sorted(found) == want, (items, text)


def test_query_cases(spark):
    ten = "Eins zwei drei vier fünf sechs sieben acht neun zehn"
    items = [(7, ten + " elf"), (8, "only three words"), (8, "Another-text"), (9, None), (10, "..."), (None, "ghost words")]
    docs = [(1, "x " + ten.upper().replace("Ü", "ü") + " y"), (2, "say ONLY, three: words!"), (3, None), (4, ""), (5, "only three"), (6, "ghost words"), (6, "ghost words"), (None, "another text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(*d, 0, "k") for d in docs], "doc_id long, text string, n_words int, items string")
    rows = {(r["doc_id"], r["n_hit"]): r for r in D.digest(frame, bench).collect()}
    assert len(rows) == 7
    assert rows[1, 10]["contaminated"] and rows[1, 10]["n_words"] == 12 and rows[1, 10]["items_sha256"] == D.items_sha256(["7"])
    assert rows[2, 3]["n_items"] == 1 and rows[3, 0]["n_words"] == 0 and not rows[5, 0]["contaminated"]
    assert rows[None, 2]["n_items"] == 1
    assert rows[6, 0]["items_sha256"] == D.items_sha256([])


def test_clean_removes_spans_only(spark):
    ten = "a b c d e f g h i j"
    bench = spark.createDataFrame([(1, ten)], "item_id long, text string")
    clean_text = "nothing to  see\nhere, at all"
    rows = [(1, clean_text, 28), (2, f"before it {ten.upper()}. After it more words stand here now", 70), (3, ten, 19), (4, None, 0)]
    frame = spark.createDataFrame([(*r, "s", 1, "c") for r in rows], "doc_id long, text string, n_chars long, spans string, n_words int, c1 string")
    done = D.clean(frame, bench)
    assert done.columns == frame.columns and {(r["spans"], r["n_words"], r["c1"]) for r in done.collect()} == {("s", 1, "c")}
    out = {r["doc_id"]: r for r in done.collect()}
    assert out[1]["text"] == clean_text and out[1]["n_chars"] == 28
    assert out[2]["text"] == "before it . After it more words stand here now" and out[2]["n_chars"] == len(out[2]["text"])
    assert 3 not in out and out[4]["text"] is None


def test_several_automata_and_empty_tables(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices("abcd", k=14))) for i in range(6)]
    docs = [(i, " ".join(rng.choices("abcd", k=80))) for i in range(20)]
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted((r["doc_id"], [tuple(s) for s in r["spans"]], r["items"]) for r in D.scanned(frame, bench, 4).collect())
    many = sorted((r["doc_id"], [tuple(s) for s in r["spans"]], r["items"]) for r in D.scanned(frame, bench, 4, most_words=30).collect())
    assert one == many
    assert D.digest(frame.limit(0), bench).count() == 0
    assert D.digest(frame, bench.limit(0)).filter("not contaminated and n_words = 80").count() == 20

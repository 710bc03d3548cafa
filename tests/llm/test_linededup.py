import hashlib
import random
from collections import defaultdict

from loamix.llm import linededup as L

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least_docs=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    where = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                where[key(line)].add(L.NO_ID if i is None else i)
    bad = {k: max(v) for k, v in where.items() if len(v) >= least_docs}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in bad or bad[key(x)] == (L.NO_ID if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(1)
    pool = ["a line that is long enough to be judged, number %d of the pool" % i for i in range(12)] + ["short", "", "ü" * 39, "É" * 40, "  " + "Ab" * 20 + "\t"]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else rng.choice(pool).upper() + " " for _ in range(rng.randint(0, 9)))) for i in range(60)]
    return docs + [(None, pool[0] + "\n" + pool[0]), (3, pool[1]), (3, pool[1]), (70, None), (71, ""), (72, "\n" + "x" * 50_000 + "\n" + pool[2])]


def test_against_brute_force(spark):
    docs = cases()
    frame = spark.createDataFrame([(*d, "f", 1) for d in docs], "doc_id long, text string, hash string, doc int")
    for options in ({}, {"batches": 7, "fanout": 2}, {"batches": 1}):
        got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in L.digest(frame, **options).collect()), key=str)
        assert got == brute(docs)
    assert L.digest(frame.limit(0)).count() == 0


def test_deduped_keeps_other_columns(spark):
    docs = cases()
    frame = spark.createDataFrame([(i, t, len(t or ""), "en", 3, "h") for i, t in docs], "doc_id long, text string, n_chars long, doc string, n_lines int, hash string")
    out = L.deduped(frame).collect()
    assert out[0].__fields__ == frame.columns and {(r["doc"], r["n_lines"], r["hash"]) for r in out} == {("en", 3, "h")}
    assert all(r["n_chars"] == len(r["text"] or "") for r in out)
    assert any(r["text"] is None for r in out)


def test_runs_are_levelled_and_probed(spark):
    frame = spark.createDataFrame([(i, f"{'word ' * 10}{i % 5}") for i in range(10)], "doc_id long, text string")
    runs = L.LineRuns(spark, fanout=2)
    for k in range(5):
        suspects, _ = runs.feed(L.line_hashes(frame.filter(f"doc_id % 5 = {k}")))
        assert sorted(r["doc"] for r in suspects.collect()) == [k, k + 5]  # both rows of the batch hold the line
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted((r["n_docs"], r["max_doc"]) for r in runs.index().collect()) == [(2, k) for k in range(5, 10)]
    new = L.line_hashes(spark.createDataFrame([(99, f"{'word ' * 10}3\n{'other ' * 9}")], "doc_id long, text string"))
    assert runs.unseen(new).count() == 1
    assert runs.feed(new)[0].count() == 1  # the line that the runs knew
    runs.drop()


def test_runs_meet_without_a_shuffle(spark):
    """Probing is a merge anti-join, and neither it nor compaction moves a run or reads a batch again."""
    frame = spark.createDataFrame([(i, f"{'word ' * 10}{i % 7}") for i in range(40)], "doc_id long, text string")
    runs = L.LineRuns(spark, fanout=9)
    for k in range(3):
        runs.feed(L.line_hashes(frame.filter(f"doc_id % 4 = {k}")))
    names = [name for level in runs.levels for name in level]
    own = spark.table(names.pop())
    runs.levels[0].pop()
    plan = runs.unseen(own)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("LeftAnti") == 2 and "Exchange" not in plan
    merged = runs.index()._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in merged and "Exchange" not in merged and "MapInArrow" not in merged
    runs.drop()


def test_very_long_texts(spark):
    """More text than one Arrow batch may hold: rows are sliced by bytes on their way and in the worker."""
    line = "a line of sixty characters or so that is long enough to count"
    frame = spark.range(0, 300).selectExpr("id AS doc_id", f"concat('{line}', repeat('\nx', 400000), '\n', id) AS text")
    out = L.digest(frame).agg({"n_dropped": "sum", "n_lines": "min"}).first()
    assert sorted(out) == [299, 400002]

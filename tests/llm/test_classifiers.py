import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamix.llm import langid, quality, toxicity
from loamix.llm.common import texts, utf8
from loamix.llm.sampling import sample

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me") for b in ("ra", "te", "no", "shi", "pu")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_and_labels(spark, n=400):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randint(20, 300))
        good, toxic = int(i % 3 > 0), int(i % 4 == 0)
        if not good:
            text = text.replace(" ", "%%% ") if i % 2 else " ".join(w for w in text.split() for _ in range(12))
        if toxic:
            text += " you vile zork " + prose(rng, 10)
        docs.append((i, text, "en", 5))
        labels.append((i, good, toxic))
    docs += [(n, None, None, 1), (n + 1, "", "en", 1), (n, None, None, 1), (None, "text", "en", 1)]
    labels += [(n, None, 1), (5, 7, 9), (10**9, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,column,fold", [(quality, "quality", 3), (toxicity, "toxic", 5)])
def test_held_out_accuracy(spark, module, column, fold):
    docs, labels = docs_and_labels(spark)
    out = module.digest(docs, labels)
    assert out.count() == 404 and out.filter("score is null or score < 0 or score > 1").count() == 0
    joined = out.join(labels.filter(f"{column} in (0, 1) and doc_id < 400"), "doc_id").filter("held_out")
    assert joined.count() > 40
    right = joined.filter(f"predicted = {column}").count()
    assert right >= 0.97 * joined.count()
    assert out.filter("predicted <> cast(score >= 0.5 as int)").count() == 0
    nothing = module.digest(docs, labels.limit(0))
    assert {r["score"] for r in nothing.collect()} == {0.5}
    assert module.digest(docs.limit(0), labels).count() == 0


def test_quality_blocks_make_no_difference(monkeypatch):
    rng = random.Random(1)
    rows = [(prose(rng, 200), 1) for _ in range(20)] + [(prose(rng, 200).replace(" ", "## "), 0) for _ in range(20)]
    net = quality.fit(rows, steps=3)
    raw = [t.encode() for t, _ in rows[:3]] + [b"", b"x", prose(rng, 3000).encode(), b"zz zz zz " * 400]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    flat = np.frombuffer(b"".join(raw), np.uint8)
    together = net.score(flat, at)
    one_by_one = np.concatenate([net.score(np.frombuffer(r, np.uint8), np.array([0, len(r)])) for r in raw])
    assert np.allclose(together, one_by_one, atol=1e-5)
    monkeypatch.setattr(quality, "BLOCK", 1024)
    assert np.allclose(together, net.score(flat, at), atol=1e-5)


def test_quality_gradient():
    rng = np.random.default_rng(3)
    net = quality.Net(rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float64), rng.normal(0, 0.3, 2 * quality.FILTERS), 0.1)
    raw = np.frombuffer(b"some bytes of a text " * 40 + b"another", np.uint8)
    at = np.array([0, 700, len(raw)])

    def forward(table):
        flat, halves = quality.padded(raw, at)
        bounds = np.concatenate([[0], np.cumsum(halves)])
        seen = quality.responses(flat, bounds[1:] * quality.HALF, table).reshape(-1, quality.HALF, quality.FILTERS)
        where = seen.argmax(axis=1)
        top = seen.max(axis=1)
        return flat, bounds, where, top, quality.chunk_pool(top, bounds) @ net.dense

    flat, bounds, where, top, z = forward(net.table)
    grad = quality.table_gradient(flat, top, where, bounds, np.tile(net.dense, (2, 1)), net.table)
    for j, b, f in ((0, ord("o"), 3), (2, ord(" "), 7), (5, ord("t"), 0)):
        moved = net.table.copy()
        moved[j, b, f] += 1e-5
        assert abs((forward(moved)[-1].sum() - z.sum()) / 1e-5 - grad[j, b, f]) < 1e-4


def test_toxicity_long_text_equals_short_path(monkeypatch):
    rng = random.Random(2)
    model = toxicity.fit([(prose(rng, 60), 0) for _ in range(60)] + [(prose(rng, 60) + " zork vile", 1) for _ in range(60)])
    text = prose(rng, 3000) + " ZORK"
    whole = model.scorer()(text)
    monkeypatch.setattr(toxicity, "BLOCK", 997)
    assert abs(model.scorer()(text) - whole) < 1e-6


def test_language_identification(spark):
    rng = random.Random(6)
    langs = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    rows = [(i, " ".join("".join(rng.choices(letters, k=5)) for _ in range(30)), lang) for i, (lang, letters) in enumerate(list(langs.items()) * 60)]
    rows += [(500, None, "aa"), (501, "123 ²½ !?", "bb"), (502, "", None), (503, "abc", None), (504, "ñ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.digest(docs).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang in rows[:180])
    assert [out[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and out[503]["lang_pred"] == "aa" and out[504]["lang_pred"] in langs
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in langid.digest(docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("doc_id > 499")).collect()} <= {"und", ""}
    assert langid.digest(docs.limit(0)).count() == 0


def test_whole_texts_reach_python(spark):
    import pyarrow as pa

    array = pa.array(["a", None, "", "üx"])
    raw, at = utf8(array.slice(1))
    assert raw.tobytes() == "üx".encode() and at.tolist() == [0, 0, 0, 3]
    assert texts(array) == [b"a", b"", b"", "üx".encode()]


def test_quality_forward_pass_against_loops():
    """The score by the definition: filters at every place of the whole text, chunks of 512 by halves, mean and maximum."""
    rng = np.random.default_rng(8)
    net = quality.Net(rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(0, 0.3, 2 * quality.FILTERS), -0.2)
    for raw in (b"", b"x", b"a text of some length. " * 9, rng.integers(0, 256, 1900).astype(np.uint8).tobytes()):
        halves = max(1, -(-(len(raw) + quality.WIDTH - 1) // quality.HALF))
        tail = raw + bytes(halves * quality.HALF + quality.WIDTH - len(raw))
        seen = [sum(net.table[j, tail[i + j]] for j in range(quality.WIDTH)) for i in range(halves * quality.HALF)]
        chunks = [np.maximum(0, np.max(seen[a * quality.HALF : (a + 2) * quality.HALF], axis=0)) for a in range(max(1, halves - 1))]
        z = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)]) @ net.dense + net.bias
        assert abs(net.score(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] - 1 / (1 + np.exp(-z))) < 1e-5


def test_toxicity_score_against_sets():
    rng = random.Random(4)
    model = toxicity.fit([(prose(rng, 60), 0) for _ in range(60)] + [(prose(rng, 60) + " zork vile", 1) for _ in range(60)])
    for text in ("", "a", "ZORK vile zork", prose(rng, 300) + " Vile é𝔘"):
        framed = f" {text.lower()} "
        grams = {framed[i : i + n] for n in toxicity.GRAMS for i in range(len(framed) - n + 1)}

        def place(gram):
            h = len(gram)
            for c in gram:
                h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
                h ^= h >> 29
            return h >> 44

        z = model.bias + sum(float(model.weight[x]) for x in {place(g) for g in grams})
        assert abs(model.scorer()(text) - 1 / (1 + np.exp(-z))) < 1e-6


def test_near_copies_count_once():
    rng = random.Random(6)
    text = prose(rng, 200)
    rows = [(text + f" {i}", 1) for i in range(9)] + [(text, 0), ("", 0), ("", 0), ("one two", 1)]
    assert toxicity.distinct(rows) == [rows[0], *rows[9:]]
    assert 3.8 < toxicity.least_chi(20) < 3.9 and toxicity.least_chi(1 << 20) > toxicity.least_chi(1000)


def test_samples(spark):
    rows = [(i % 50, "x" * (1 + i % 50) + ("y" if i >= 50 else "")) for i in range(100)] + [(60, "z" * 99), (None, "n"), (61, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(3, 0), (4, None)], "doc_id long, label int")
    out = sample(labels, docs, 10, 40)
    assert len(out) == 20 and all(t and len(t) <= 40 and "y" not in t for t, _ in out) and sorted(v for _, v in out) == [0] * 10 + [1] * 10
    assert out == sample(labels, docs.repartition(7), 10, 40) and sample(labels.limit(0), docs, 5, 5) == []


def test_columns_of_any_name(spark, small, monkeypatch):
    monkeypatch.setattr(quality, "fit", partial(quality.fit, steps=20))
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("quality_score_", F.lit(1)).withColumn("a.b", F.lit("x")).withColumn("score", F.lit(2.0))
    out = quality.accepted(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert out.columns == docs.columns and {tuple(r) for r in out.select("quality_score_", "`a.b`", "score").collect()} == {(1, "x", 2.0)}


def test_very_long_texts(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('the vile word and ', 60000) AS text", "'en' AS lang")
    labels = spark.range(40).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality", "cast(id % 2 AS int) AS toxic")
    for module in (toxicity, quality):
        out = module.digest(docs, labels).collect()
        assert len(out) == 40 and {r["score"] for r in out} == {0.5}  # none is short enough to learn from
    assert {r["lang_pred"] for r in langid.digest(docs).collect()} == {"und"}

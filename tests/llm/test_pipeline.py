from functools import partial

import corpus_pipeline as C
from loamix.llm import quality, registry
from loamix.llm.common import table


def test_stages(spark, small):
    docs = table(spark, small, "documents")
    before = docs.count()
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.dtypes == docs.dtypes, name
        rows = after.collect()
        assert 0.5 * before < len(rows) <= before
        docs = spark.createDataFrame(rows, after.schema)
    pieces = C.STAGES[-1][1](spark, docs, small)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert [n for n, _ in C.STAGES] == ["quality", "lines", "near", "benchmark", "packing"] and C.ORACLE_SQL is None


def test_every_operator_has_one_query():
    names = sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


def odd(spark, folder):
    """Tables with null texts and ids, repeated rows, a very long text, and columns of clashing names."""
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words)
    rows = [(i, " ".join(words[i % 7 :] + [f"own{i}"] * (i % 3)) + f"\nline {i}") for i in range(60)]
    rows += [(60, None), (61, ""), (None, text), (62, text), (62, text), (63, f"{text}\n" * 300), (64, text)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_dropped int, `a.b` string")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words[100:112])), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_odd_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "fit", partial(quality.fit, steps=20))
    folder = str(tmp_path)
    docs = odd(spark, folder)
    kept = docs
    for name, stage in C.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns and kept.count() > 0, name
    assert kept.filter("n_chars <> length(text)").count() == 0
    assert kept.filter("text like '%w105 w106%'").count() == 0
    pieces = C.run(spark, folder)
    assert pieces.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{folder}/none/{name}.parquet")
    assert C.run(spark, f"{folder}/none").count() == 0

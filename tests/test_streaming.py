from loamix.operators import ingest
from loamix.sources import scratch
from loamix.streaming import ingest as S


def test_upsert_stream(spark, tmp_path):
    folder, base = tmp_path / "in", str(tmp_path / "table")
    schema = "source string, text string"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(str(folder))
        S.upsert_stream(stream, base).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame([("a", "one"), ("b", "two")], schema).write.parquet(str(folder / "1"))
    folder_files = [*folder.glob("1/*.parquet")]
    for f in folder_files:
        f.rename(folder / f"first-{f.name}")
    run()
    spark.createDataFrame([("a", "changed"), ("c", "three")], schema).write.parquet(str(tmp_path / "2"))
    for f in (tmp_path / "2").glob("*.parquet"):
        f.rename(folder / f"second-{f.name}")
    run()
    rows = {r["source"]: r["page_hash"] for r in scratch.load_version(spark, base).collect()}
    want = {r["source"]: r["page_hash"] for r in ingest.with_page_hash(spark.createDataFrame([("a", "changed"), ("b", "two"), ("c", "three")], schema)).collect()}
    assert rows == want and scratch.versions(spark, base) == [1, 2]


def test_windows_and_state(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    for name, df in (("sessions", S.session_windows(stream)), ("counts", S.event_counts(stream))):
        df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        assert spark.table(name).count() > 0
    batch = S.session_windows(events).selectExpr("user_id", "started", "n")
    assert spark.table("sessions").selectExpr("user_id", "started", "n").subtract(batch).count() == 0
    turns = spark.read.parquet(f"{small}/conversations.parquet")
    turns.coalesce(1).write.parquet(str(tmp_path / "turns"))
    live = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "turns"))
    S.recent_messages(live, keep=2, idle_ms=None).writeStream.format("memory").queryName("recent").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.table("recent").collect()
    assert len(rows) == turns.select("conv_id").distinct().count() and sum(r["n_seen"] for r in rows) == turns.count()

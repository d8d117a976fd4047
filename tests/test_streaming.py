from pyspark.sql import functions as F

from dialoom import streaming

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_windows_equal_a_batch(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    folder = str(tmp_path / "events")
    batch.repartition(3).write.parquet(folder)
    stream = streaming.event_stream(spark, folder, batch.schema)
    got = streaming.drain(streaming.windowed_counts(stream, "1 day", "3650 days"), "windows", "complete", str(tmp_path / "c"))
    want = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "event_type").count()
    assert sorted((r.start, r.event_type, r.n) for r in got.collect()) == sorted((r.window.start, r.event_type, r["count"]) for r in want.collect())


def test_sessions_cover_all_events(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    folder = str(tmp_path / "events")
    batch.write.parquet(folder)
    stream = streaming.event_stream(spark, folder, batch.schema)
    got = streaming.drain(streaming.sessions(stream, late="3650 days"), "sessions", "complete", str(tmp_path / "c"))
    assert got.agg(F.sum("n")).first()[0] == batch.filter("ts IS NOT NULL").count()

from pyspark.sql import functions as F

from paths import SF
from spanforge.streaming import windows


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").orderBy("ts").repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = windows.read_stream(spark, str(tmp_path / "in"), schema, 1)
    counted = windows.windowed_counts(stream, "ts", ["event_type"], "1 day", "60 days")
    query = counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = windows.windowed_counts(spark.read.parquet(str(tmp_path / "in")), "ts", ["event_type"], "1 day", "60 days")
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"], round(r["total"], 6)) for r in df.collect())
    assert key(spark.table("counted")) == key(batch) and sum(r["n"] for r in batch.collect()) == events.count()


def test_points_of_a_stream_meet_intervals(spark, tmp_path):
    spark.createDataFrame([("k", i) for i in range(1, 50)], "chrom string, p long").write.parquet(str(tmp_path / "p"))
    stream = windows.read_stream(spark, str(tmp_path / "p"), spark.read.parquet(str(tmp_path / "p")).schema)
    table = spark.createDataFrame([("k", 5, 9, "a"), ("k", 8, 20, "b")], "chrom string, s long, e long, name string")
    joined = windows.assign_points(stream, table, ["chrom"], "p", "s", "e", 4)
    query = joined.writeStream.format("memory").queryName("met").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("met").count() == 5 + 13


def test_sessions(spark):
    rows = spark.createDataFrame([("u", f"2024-01-01 00:{m:02d}:00") for m in (0, 2, 4, 30, 31)], "user string, ts string")
    out = windows.sessions(rows, "ts", ["user"], "5 minutes", "1 hour").orderBy("start").collect()
    assert [r["n"] for r in out] == [3, 2]

"""Streams over files: batches that replace themselves, and windows in event time."""

from pyspark.sql import functions as F

from ledgerspark.streaming import activity

SF = "/root/testdata/sf0.001"


def test_ingest_writes_every_row_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        activity.ingest(stream, lambda b: b, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == events.count() == out.select("event_id").distinct().count()


def test_tumbling_counts_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    got = activity.tumbling(events, "at", "1 hour", "1 day", "event_type").agg(F.sum("events").alias("n")).first()["n"]
    assert got == events.count()

"""Streamed sessions equal those of the batch operator."""

from pyspark.sql import functions as F

from veristrata.operators.windows import gap_sessions as batch_sessions
from veristrata.streaming.sessions import gap_sessions

DIR = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DIR}/events.parquet").select("event_id", "user_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = gap_sessions(stream, "user_id", "ts", 21600).writeStream.outputMode("complete").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = sorted((r.user_id, r.n, r.session_end) for r in spark.table("sessions").collect())
    want = batch_sessions(events, ["user_id"], "ts", "event_id", [21600]).groupBy("user_id", "session").agg(F.count("*").alias("n"), F.max(F.col("ts").cast("timestamp")).alias("e")).collect()
    assert got == sorted((r.user_id, r.n, r.e) for r in want)

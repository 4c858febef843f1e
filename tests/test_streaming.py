"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from corpusloom.operators import windows
from corpusloom.streaming import changes


def _stream(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/events.parquet").select(F.col("user_id").cast("string").alias("url"), F.col("event_id").alias("seq"), F.col("event_type").alias("hash"), "ts", "event_type")
    path = str(tmp_path / "events")
    rows.orderBy("seq").limit(400).coalesce(1).write.parquet(path)
    rows.orderBy("seq").offset(400).coalesce(1).write.mode("append").parquet(path)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def test_change_detection(spark, small, tmp_path):
    rows, _ = _stream(spark, small, tmp_path)
    one = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "events"))  # one batch: files have no order
    got = {(r.seq, r.change) for r in _run(changes.detect_changes(one), "changes").collect()}
    want = {(r.seq, r.change) for r in windows.changes(rows, "url", ["seq"], "hash").collect()}
    assert got == want


def test_windowed_counts(spark, small, tmp_path):
    rows, stream = _stream(spark, small, tmp_path)
    got = {tuple(r) for r in _run(changes.windowed_counts(stream, "ts", "event_type", "1 day", late="1000 days"), "counts", "complete").collect()}
    batch = rows.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    assert got == {tuple(r) for r in batch.select("w.start", "event_type", "n").collect()}


def test_first_seen(spark, small, tmp_path):
    rows, stream = _stream(spark, small, tmp_path)
    assert _run(changes.first_seen(stream, "url", "ts", "1000 days"), "seen").count() == rows.select("url").distinct().count()


def test_run_available_goes_on(spark, small, tmp_path):
    rows, stream = _stream(spark, small, tmp_path)
    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for _ in range(2):  # the second run finds nothing new
        changes.run_available(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/run={n}"), at)
    assert spark.read.parquet(out).count() == rows.count()

from pyspark.sql import functions as F

from pulsegrid.operators.rollup import rollup
from pulsegrid.sources import tables as T
from pulsegrid.streaming import rollups as R


def test_stream_rollup_equals_batch(spark, small, tmp_path):
    samples = T.gauges(spark, small)
    # the last sample closes all windows before it
    end = samples.agg(F.max("ts_ms")).first()[0] + 10 * 3_600_000
    tail = spark.createDataFrame([("end", {}, end, 0.0)], samples.schema)
    samples.repartition(2).write.parquet(str(tmp_path / "in"))
    schema = samples.schema
    out = str(tmp_path / "out")
    run = lambda: R.windowed_rollup(R.sample_stream(spark, str(tmp_path / "in"), schema), "1 hour", "60 days").drop("sketch").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    run()
    tail.withColumn("ts_ms", F.col("ts_ms") + 70 * 86_400_000).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {(r["series_key"], r["bucket"]): (r["n"], round(r["sum"], 6)) for r in spark.read.parquet(out).collect()}
    want = {(r["series_key"], r["bucket"]): (r["n"], round(r["sum"], 6)) for r in rollup(samples, "h").collect()}
    assert got == want


def test_batches_replace_themselves(spark, small, tmp_path):
    samples = T.gauges(spark, small)
    samples.write.parquet(str(tmp_path / "in"))
    seen = []
    q = R.write_batches(R.sample_stream(spark, str(tmp_path / "in"), samples.schema), str(tmp_path / "out"), str(tmp_path / "cp"), keep=F.col("value") > 5, quarantine=str(tmp_path / "bad"), then=lambda df, n: seen.append(n))
    q.awaitTermination()
    good, bad = (spark.read.parquet(str(tmp_path / x)).count() for x in ("out", "bad"))
    assert good + bad == samples.count() and good == samples.where("value > 5").count() and seen


def test_stream_deduplication(spark, tmp_path):
    rows = spark.createDataFrame([(1000, "a"), (1500, "a"), (2000, "b")], "ts_ms long, doc_id string")
    rows.write.parquet(str(tmp_path / "in"))
    q = R.unique_records(R.sample_stream(spark, str(tmp_path / "in"), rows.schema)).writeStream.format("memory").queryName("unique_docs").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT doc_id FROM unique_docs").count() == 2

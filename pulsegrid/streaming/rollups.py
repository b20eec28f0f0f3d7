"""Continuous ingestion: watermarked rollups, de-duplication, and idempotent writing of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.series import series_key
from ..operators.rollup import statistics


def sample_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 16) -> DataFrame:
    """Parquet files of samples as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def windowed_rollup(samples: DataFrame, size: str = "1 minute", late: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Statistics per series and window of event time. Samples later than `late` behind the newest one are dropped, and a
    window is emitted once no such sample can come. Works on streams and, then without dropping, on tables."""
    ts = F.timestamp_millis(F.col("ts_ms"))
    rows = samples.withColumn("ts", ts).withColumn("series_key", series_key("metric", "labels"))
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    by = rows.withWatermark("ts", late).groupBy(window.alias("w"), "series_key").agg(*statistics())
    return by.select("series_key", F.unix_millis(F.col("w.start")).alias("bucket"), "n", "sum", "min", "max", "var", "sketch")


def unique_records(records: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream with each doc_id once, as far back as the watermark goes."""
    return records.withColumn("ts", F.timestamp_millis(F.col("ts_ms"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_id"]).drop("ts")


def write_batches(stream: DataFrame, path: str, checkpoint: str, keep: Column | None = None, quarantine: str | None = None, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Writes each micro-batch to a folder of its own number, so a batch that is run again replaces itself. Rows for which
    `keep` is not true go to the quarantine folder; `then` gets the kept rows, for further tables."""

    def one(batch: DataFrame, number: int) -> None:
        good = batch if keep is None else batch.where(F.coalesce(keep, F.lit(False)))
        good.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if keep is not None and quarantine:
            batch.where(~F.coalesce(keep, F.lit(False))).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        if then:
            then(good, number)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()

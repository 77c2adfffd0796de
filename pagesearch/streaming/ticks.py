"""Change events counted per tumbling tick of event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesearch.schemas import WATCH_INTERVAL

COUNTED_KINDS = ["write", "create"]


def change_ticks(events: DataFrame, interval: str = WATCH_INTERVAL, delay: str = "1 minute") -> DataFrame:
    """Count ``write``/``create`` events per ``interval`` window of ``ts``.
    ``ts`` may be TIMESTAMP_NTZ (Parquet), which a watermark refuses, so it is
    cast to TIMESTAMP first.  The watermark bounds the state; rows later than
    it are dropped.  A tick without events produces no row (nothing runs)."""
    ev = (events.where(F.col("kind").isin(COUNTED_KINDS))
          .withColumn("ts", F.col("ts").cast("timestamp")))
    if events.isStreaming:
        ev = ev.withWatermark("ts", delay)
    return (ev.groupBy(F.window("ts", interval).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(F.unix_seconds(F.col("w.start")).alias("window_start"),
                    F.unix_seconds(F.col("w.end")).alias("window_end"), "n_events"))


def run_change_ticks(spark, source_dir: str, sink_dir: str, checkpoint: str, schema,
                     interval: str = WATCH_INTERVAL, delay: str = "1 minute", timeout_s: int | None = None) -> DataFrame:
    """Run the tick count over a file stream in update mode; each micro-batch
    appends its updated windows with its batch id (idempotent: the batch's
    folder is overwritten on retry).  The result keeps, per window, the row of
    the latest batch: the final counts, including the still-open last window
    that append mode would hold back."""
    from pagesearch.streaming.runner import drain, file_stream
    stream = file_stream(spark, source_dir, schema)
    ticks = change_ticks(stream, interval, delay)

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
         .write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}"))

    drain(ticks.writeStream.outputMode("update").foreachBatch(sink), checkpoint, timeout_s)
    return read_ticks(spark, sink_dir)


def read_ticks(spark, sink_dir: str) -> DataFrame:
    out = spark.read.parquet(sink_dir)
    return (out.groupBy("window_start", "window_end")
            .agg(F.max_by("n_events", "batch_id").alias("n_events")))

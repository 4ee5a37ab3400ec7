"""Progress events as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events of each type in tumbling windows; the watermark bounds the state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def append_once(batch: DataFrame, batch_id: int, path: str) -> None:
    """A sink for ``foreachBatch``: a batch has a folder of its own, so a repeated batch replaces itself."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def publish_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return events.writeStream.foreachBatch(lambda df, n: append_once(df, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Positions that arrive while a measurement runs.

A stream of Parquet files (pos_idx, spectrum) is computed per micro-batch into the same results and status tables that a
batch run keeps. A micro-batch writes partitions named by its number, so one that is tried again replaces its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def compute_arrivals(stream: DataFrame, expression: Column, folder: str, checkpoint: str, result: str = "double") -> StreamingQuery:
    """Starts a query that computes everything there is, marks it, and ends; start it again for what came since."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = f"{folder}/results/batch={number:012d}"
        batch.select("pos_idx", expression.cast(result).alias("result")).write.mode("overwrite").parquet(at)
        spark.read.parquet(at).select("pos_idx").write.mode("overwrite").parquet(f"{folder}/status/batch={number:012d}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_means(events: DataFrame, time: str, value: str, by: list[str], width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Means per window of event time, for batches and streams; a stream forgets windows once they are `late`."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    out = marked.groupBy(F.window(time, width).alias("w"), *by).agg(F.avg(value).alias("value"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *by, "value", "n")

"""A folder of files as a stream into a store of documents, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Takes in new Parquet files of (source, etag, text) and writes each batch as a version of the store; `current` reads the latest row of each source."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["source", "etag"]).withColumn("version", F.lit(number)).write.mode("overwrite").parquet(f"{store}/version={number:09d}")

    schema = "source string, etag string, text string"
    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    """(source, etag, text) of the latest version of each source."""
    rows = spark.read.option("basePath", store).parquet(f"{store}/version=*")
    return rows.groupBy("source").agg(F.max_by(F.struct("etag", "text"), F.struct("version", "etag")).alias("r")).select("source", "r.*")


def windowed(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type, value) by window and type; works on tables and streams, which drop what is later than `late`."""
    out = events.withColumn("ts", events["ts"].cast("timestamp"))
    out = out.withWatermark("ts", late) if events.isStreaming else out
    by = out.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("window.start").alias("starts"), "event_type", "n", "total")

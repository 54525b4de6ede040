"""Incremental ingestion with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import chunks


def stream_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(docs: DataFrame, index_path: str, checkpoint: str, size: int = 1000, overlap: int = 100):
    """Chunk new documents and append them to an index; the batch number makes a repeated batch overwrite itself."""

    def write(batch: DataFrame, number: int) -> None:
        chunks(batch, "doc_id", "text", size, overlap).write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_requests(requests: DataFrame, time_col: str = "ts", within: str = "1 hour") -> DataFrame:
    """Each API request once: repeats of a key within the watermark are dropped."""
    from ..functions.text import cache_key

    keyed = requests.withColumn("key", cache_key("method", "query")).withWatermark(time_col, within)
    return keyed.dropDuplicatesWithinWatermark(["key"])


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed counts of a stream of events; what is later than the watermark is dropped."""
    seen = events.withWatermark("ts", late)
    return seen.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

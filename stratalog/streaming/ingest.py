"""Structured Streaming: JSON files into an index, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalog.sources.ingest import json_objects, logs_of, metrics_of
from stratalog.sources.store import Catalog


def json_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of JSON from a folder that grows; ``files_per_trigger`` keeps back-pressure."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "body")


def stream_logs(catalog: Catalog, index: str, source: DataFrame, checkpoint: str, once: bool = True, name: str = "logs") -> StreamingQuery:
    """Appends a stream of JSON bodies to an index. The checkpoint takes the place of a write-ahead log: after
    a crash the query goes on where its last commit left off. A batch that is run again after it was appended takes
    the place of what it wrote: it is stored under the ``name`` of the stream and its number."""

    def write(batch: DataFrame, number: int) -> None:
        catalog.append_logs(index, logs_of(json_objects(batch)), f"s-{name}-{number}")

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def stream_metrics(catalog: Catalog, index: str, source: DataFrame, checkpoint: str, name: str = "metrics") -> StreamingQuery:
    """Appends a stream of metric bodies to an index, like ``stream_logs``."""
    writer = source.writeStream.foreachBatch(lambda batch, number: catalog.append_metrics(index, metrics_of(json_objects(batch)), f"s-{name}-{number}"))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(logs: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes", key: str | None = None) -> DataFrame:
    """Documents by window (tumbling, or sliding with ``slide``), for streams and tables; what comes later than ``late`` is left out of streams."""
    marked = logs.withWatermark("ts", late) if logs.isStreaming else logs
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    keys = [window, *([F.col("fields")[key].alias(key)] if key else [])]
    out = marked.groupBy(*keys).count()
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *([key] if key else []), "count")


def sessions(logs: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of documents of a key with pauses of less than ``gap``."""
    marked = logs.withWatermark("ts", late) if logs.isStreaming else logs
    out = marked.groupBy(F.session_window("ts", gap), F.col("fields")[key].alias(key)).count()
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "count")

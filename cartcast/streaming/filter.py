"""The catalogue filter (C1) as a Structured Streaming job.

The original pipeline is batch only; this is the same operator run
incrementally over a folder that receives new log files: a stream-static
semi-join against the catalogue, written to Parquet with a checkpoint so a
restarted query resumes where it stopped and a lost executor costs a retry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from cartcast.operators.filter import filter_log
from cartcast.session import shared_path
from cartcast.sources.events import log_from_events


def start_filter_stream(
    spark: SparkSession,
    source_dir: str,
    items: DataFrame,
    sink_path: str,
    checkpoint_path: str,
    to_log: Callable[[DataFrame], DataFrame] = log_from_events,
    file_glob: str = "*.parquet",
    available_now: bool = True,
):
    """Start the stream; returns the ``StreamingQuery``.

    ``source_dir`` is a folder receiving Parquet files whose names match
    ``file_glob``; the schema is taken from the files present at start.
    ``available_now`` processes what is there and stops; otherwise the query
    keeps polling.
    """
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(source_dir).schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_glob)
        .option("maxFilesPerTrigger", 64)
        .parquet(source_dir)
    )
    filtered = filter_log(to_log(stream), items)
    writer = (
        filtered.writeStream.format("parquet")
        .option("path", sink_path)
        .option("checkpointLocation", checkpoint_path)
        .outputMode("append")
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def stream_filter_log(
    spark: SparkSession,
    source_dir: str,
    items: DataFrame,
    to_log: Callable[[DataFrame], DataFrame] = log_from_events,
    file_glob: str = "*.parquet",
) -> DataFrame:
    """Run the stream over everything present, then read its output back."""
    sink = shared_path(spark, "stream_filter_out")
    ckpt = shared_path(spark, "stream_filter_ckpt")
    query = start_filter_stream(spark, source_dir, items, sink, ckpt, to_log, file_glob)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"filter stream failed: {query.exception()}")
    return spark.read.parquet(sink)

"""Micro-batch forms of the operators: the same expressions over file streams, and windowed roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.dialect import infer_dialect
from ..operators.extract import extract_fields
from ..operators.governance import consented_events


def stream_table(spark: SparkSession, path: str, schema: StructType, files: int = 64) -> DataFrame:
    """A stream of the Parquet files that appear in ``path``, at most ``files`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_dialect(events: DataFrame, text_col: str = "transcript") -> DataFrame:
    return infer_dialect(events, text_col)


def stream_fields(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return extract_fields(docs, id_col, text_col)


def _time(events: DataFrame, name: str) -> Column:
    """The event time; a stream's watermark needs a time with zone (the session's)."""
    return F.col(name).cast("timestamp") if events.isStreaming else F.col(name)


def windowed_counts(events: DataFrame, time_col: str = "ts", late: str = "2 days", window: str = "1 day") -> DataFrame:
    """(window_start, product, events, consented): tumbling windows; what comes later than ``late`` is left out.
    Works on streams and on tables (where nothing is late)."""
    timed = events.withColumn("_t", _time(events, time_col)).withWatermark("_t", late)
    out = timed.groupBy(F.window("_t", window), "product").agg(F.count("*").alias("events"), F.count_if(F.coalesce(F.col("consent"), F.lit(False))).alias("consented"))
    return out.select(F.col("window.start").alias("window_start"), "product", "events", "consented")


def deduplicated(events: DataFrame, keys: list[str], time_col: str = "ts", late: str = "7 days") -> DataFrame:
    """Each combination of ``keys`` once within the watermark; state older than ``late`` is dropped."""
    return events.withColumn("_t", _time(events, time_col)).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def write_stream(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream as Parquet until its source is used up."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def sink_consented(events: DataFrame, path: str, checkpoint: str, enabled: bool = True) -> StreamingQuery:
    """Append the consented events of a stream as JSON lines."""
    return consented_events(events, enabled).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

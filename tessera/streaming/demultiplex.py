"""The batch operators over streams of files and of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.demux import assign


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def demultiplex_stream(reads: DataFrame, seq: Column, names: DataFrame, column: str = "guide_name") -> DataFrame:
    """Assign arriving reads: a join of the stream with a fixed table, so no state is kept."""
    return assign(reads, seq, names, column)


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per event-time window; rows later than ``late`` behind the newest one are left out."""
    w = F.window(F.col(time), window, slide) if slide else F.window(F.col(time), window)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def distinct_records(stream: DataFrame, record: str, time: str, late: str = "1 day") -> DataFrame:
    """The first delivery of every record; ids are forgotten once the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([record])


def write_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there and stop; started again, it goes on where it stopped."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()

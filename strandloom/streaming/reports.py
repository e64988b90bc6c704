"""Reports over reads and intervals that keep arriving: file-source streams with running aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sequences import filter_report

READS = "ord long, id string, seq string, qual string, arrived timestamp"


def read_stream(spark: SparkSession, folder: str, schema: str = READS, files_per_trigger: int = 16) -> DataFrame:
    """Rows of Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def running_report(reads: DataFrame, **limits) -> DataFrame:
    """The filter report over all that has arrived; for complete mode. Its counters add up, so that state is one row."""
    return filter_report(reads, **limits)


def windowed_counts(rows: DataFrame, at: str = "arrived", window: str = "10 minutes", late: str = "30 minutes", by: str | None = None) -> DataFrame:
    """Rows by time window (and a column), windows closed once nothing so late is waited for; for append mode."""
    keys = [F.window(at, window).alias("w"), *([F.col(by)] if by else [])]
    return rows.withWatermark(at, late).groupBy(*keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *([by] if by else []), "n")


def write_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there now and stop; called again, go on behind it. The checkpoint is the caller's, in shared storage."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").start(path)
    return writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()

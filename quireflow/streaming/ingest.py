"""Incremental ingestion: new marked-text files are chunked and appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import ingest


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, text) of new ``*.txt`` files below ``path``."""
    src = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_batch)
    return src.schema("value string").load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def start(spark: SparkSession, source: str, root: str, checkpoint: str, category: str = "general", once: bool = True) -> StreamingQuery:
    """Ingest what is new; a batch that is run again after a failure writes the same partitions again."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            ingest.write(ingest.ingest(ingest.register(df, category)), root)

    out = read_stream(spark, source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="1 minute")).start()


def late_events(events: DataFrame, time: str, key: str, lateness: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts per key and window with a watermark; works on streams and tables."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), key).count().select(F.col("window.start").alias("start"), key, "count")

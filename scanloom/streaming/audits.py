"""Streams: files that arrive are audited batch by batch; events are counted by window.

These go beyond the audited rule set's own features, which know no streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scanloom.operators.base_rules import file_detectors
from scanloom.operators.detectors import scan_files

FILES = "skill_id string, file_ord long, rel_path string, content string, language string, size long"


def file_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Parquet files of file rows (FILES) as they arrive in a folder."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", max_files).parquet(folder)


def audit_stream(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands the hits of each batch of files to a sink, with the batch's number to write it once."""
    detectors = file_detectors()

    def batch(rows: DataFrame, number: int) -> None:
        sink(scan_files(rows, detectors), number)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): events by window and type; works on a stream and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")

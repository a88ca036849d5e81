"""Segmentation of streams: each row stands alone, so a stream takes the same transform as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexweave.functions.model import SegmenterModel


def text_stream(spark, path: str, max_files: int = 100) -> DataFrame:
    """(text) of lines of files as they come into a folder."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(F.col("value").alias("text"))


def segment_stream(stream: DataFrame, model: SegmenterModel, text: str = "text") -> DataFrame:
    return stream.withColumn("tokens", model.tokenize(F.col(text)))


def write_segments(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Segments as a stream: an extension for transcripts that arrive while a recording goes on.

Event time is the wall clock of a segment's start. State is bounded by the watermark: segments later than it are dropped
by Spark, as it says in its metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import text as T

SCHEMA = "recording string, seq int, speaker string, begun timestamp, start double, end double, text string"


def read_segments(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New JSON-lines files of a folder, in batches."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def first_heard(segments: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Segments without exact repetitions: equal recording, times, speaker and normalised text; the first to arrive counts."""
    marked = segments.withColumn("_norm", T.normalize_for_dedup(F.col("text"))).where("_norm <> ''").withWatermark("begun", delay)
    return marked.dropDuplicatesWithinWatermark(["recording", "start", "end", "speaker", "_norm"]).drop("_norm")


def speech_time(segments: DataFrame, window: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """Per window, recording and speaker: segments, words and seconds of speech."""
    grouped = segments.withWatermark("begun", delay).groupBy(F.window("begun", window), "recording", "speaker")
    return grouped.agg(F.count("*").alias("segments"), F.sum(F.size(T.tokens(F.col("text")))).alias("words"), F.sum(F.col("end") - F.col("start")).alias("seconds")).select(F.col("window.start").alias("from"), "recording", "speaker", "segments", "words", "seconds")

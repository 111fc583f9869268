"""Energy voice activity: frames to speech windows, as gaps and islands, with no Python.

A frame speaks if its energy reaches the threshold. Speech goes on over silences of up to ``max_silence``; windows
longer than ``max_dur`` are cut there; shorter ones than ``min_dur`` go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions import fixed_values as V


def speech_windows(frames: DataFrame, keys: list[str], frame_seconds: float, threshold: float = V.VAD["threshold"], max_silence: float = V.VAD["max_silence"], min_dur: float = V.VAD["min_dur"], max_dur: float = V.VAD["max_dur"]) -> DataFrame:
    """frames: keys, time (start of a frame), energy -> keys, start, end."""
    by = Window.partitionBy(*keys).orderBy("time")
    speech = frames.where(F.col("energy") >= threshold).select(*keys, "time")
    before = F.lag("time").over(by)
    new = F.when(before.isNull() | (F.col("time") - (before + frame_seconds) > max_silence), 1).otherwise(0)
    islands = speech.withColumn("_new", new).withColumn("island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(*keys, "island").agg(F.min("time").alias("a"), (F.max("time") + frame_seconds).alias("b"))
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil((F.col("b") - F.col("a")) / max_dur).cast("int") - 1, F.lit(0)))
    pieces = spans.select(*keys, "a", "b", F.explode(cuts).alias("k"))
    pieces = pieces.select(*keys, (F.col("a") + F.col("k") * max_dur).alias("start"), F.least(F.col("b"), F.col("a") + (F.col("k") + 1) * max_dur).alias("end"))
    return pieces.where(F.col("end") - F.col("start") >= min_dur)


def region_times(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Regions of which start, end or both may be missing: they follow from the duration and the end so far."""
    from voxframe.operators.folds import ordered_fold

    return ordered_fold(regions, keys, ["seq"], _Regions, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in regions.schema if f.name in keys) + ", start double, end double")


class _Regions:
    def __init__(self):
        self.cursor = 0.0

    def push(self, row: dict) -> list[dict]:
        start, end, length = row["start"], row["end"], row["duration"]
        if end is None:
            if length is None:
                return []
            start = self.cursor if start is None else start
            end = start + length
        elif start is None:
            start = self.cursor if length is None else end - length
        start, end = max(0.0, start), min(row["total"], end)
        if end <= start:
            return []
        self.cursor = max(self.cursor, end)
        return [{k: v for k, v in row.items() if k not in ("seq", "duration", "total")} | {"start": start, "end": end}]

    def close(self) -> list[dict]:
        return []

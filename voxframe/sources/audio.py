"""WAV files in and out, with the standard library and numpy.

Samples come as floats in -1..1, whatever their width; 8-bit ones are unsigned and centred at 128.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_TYPES = {1: "u1", 2: "<i2", 4: "<i4"}


def read_wav(raw: bytes, start: float | None = None, end: float | None = None) -> tuple[int, np.ndarray]:
    """(rate, samples by channel) of a range in seconds."""
    with wave.open(io.BytesIO(raw)) as w:
        rate, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
        a = min(int((start or 0) * rate), w.getnframes())
        b = w.getnframes() if end is None else min(int(end * rate), w.getnframes())
        w.setpos(a)
        frames = w.readframes(max(0, b - a))
    if width == 3:
        bytes3 = np.frombuffer(frames, np.uint8).reshape(-1, 3)
        x = (np.concatenate([np.zeros((len(bytes3), 1), np.uint8), bytes3], 1).view("<i4")[:, 0]) / 2.0**31
    else:
        x = np.frombuffer(frames, _TYPES[width]).astype(np.float64)
        x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).T


def write_wav(channels: list[np.ndarray], rate: int) -> bytes:
    """16-bit samples, clipped, rounded to even."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(channels))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.rint(np.clip(np.stack(channels, 1), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def load(files: DataFrame, mode: str = "first", start: float | None = None, end: float | None = None) -> DataFrame:
    """files (name, content) -> name, rate, offset, and samples, or left and right for mode "stereo".

    Modes: "first" channel, "mean" of all, "stereo" (two channels at least, or it is an error).
    """
    columns = "left array<float>, right array<float>" if mode == "stereo" else "samples array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["name"], batch["content"]):
                rate, x = read_wav(bytes(raw), start, end)
                if mode == "stereo":
                    if len(x) < 2:
                        raise ValueError(f"{name} has one channel; two are needed")
                    rows.append((name, rate, start or 0.0, x[0].tolist(), x[1].tolist()))
                else:
                    rows.append((name, rate, start or 0.0, (x[0] if mode == "first" else x.mean(0)).tolist()))
            yield pd.DataFrame(rows, columns=["name", "rate", "offset", *(["left", "right"] if mode == "stereo" else ["samples"])])

    return files.select("name", "content").mapInPandas(run, f"name string, rate int, offset double, {columns}")


def to_wav(audio: DataFrame, channels: list[str]) -> DataFrame:
    """audio (name, rate, channel columns) -> name, content: bytes of WAV files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r["name"], write_wav([np.asarray(r[c], np.float64) for c in channels], int(r["rate"]))) for r in batch.to_dict("records")]
            yield pd.DataFrame(rows, columns=["name", "content"])

    return audio.select("name", "rate", *channels).mapInPandas(run, "name string, content binary")


def cut(files: DataFrame, start: float, end: float) -> DataFrame:
    """files (name, content) cut to [start, end) seconds, all channels."""
    if start < 0 or end <= start:
        raise ValueError("a range starts at 0 or later and ends after its start")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["name"], batch["content"]):
                rate, x = read_wav(bytes(raw), start, end)
                rows.append((name, write_wav(list(x), rate)))
            yield pd.DataFrame(rows, columns=["name", "content"])

    return files.select("name", "content").mapInPandas(run, "name string, content binary")

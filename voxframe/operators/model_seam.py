"""The place for a speech model: a table of audio chunks through any transcriber, loaded once per task.

load() gives a function (samples at 16 kHz, rate) -> text. Chunks are resampled before they reach it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from voxframe.operators.signal import resample

RATE = 16000


def _heard(batch: pd.DataFrame, state: list, load: Callable, rate: int, options: dict) -> Iterator:
    """What the model says to each row, null to empty ones; state holds the model once there is one."""
    for samples, own in zip(batch["samples"], batch["rate"]):
        x = resample(np.asarray(samples, np.float32), int(own), rate)
        if len(x) and not state:
            state.append(load())
        yield state[0](x, rate, **options) if len(x) else None


def transcribe(chunks: DataFrame, keys: list[str], load: Callable[[], Callable[..., str]], rate: int = RATE, options: dict | None = None) -> DataFrame:
    """chunks: keys, rate, samples -> keys, text. Empty chunks give empty texts and don't reach the model, which is given
    the options by name."""
    types = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list = []
        for batch in batches:
            yield batch[keys].assign(text=[t or "" for t in _heard(batch, state, load, rate, options or {})])

    return chunks.select(*keys, "rate", "samples").mapInPandas(run, f"{types}, text string")


def transcribe_segments(chunks: DataFrame, keys: list[str], load: Callable[[], Callable], rate: int = RATE, options: dict | None = None) -> DataFrame:
    """The same with a model that gives segments (start, end, text, in seconds of the chunk): keys, n, start, end, text.
    A plain text is a segment over the whole chunk."""
    types = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list = []
        for batch in batches:
            rows = []
            places = batch[keys].itertuples(index=False, name=None)
            for key, samples, own, said in zip(places, batch["samples"], batch["rate"], _heard(batch, state, load, rate, options or {})):
                if isinstance(said, str):
                    said = [{"start": 0.0, "end": len(samples) / own, "text": said}]
                rows += [(*key, n, float(s["start"]), float(s["end"]), s["text"]) for n, s in enumerate(said or [])]
            yield pd.DataFrame(rows, columns=[*keys, "n", "start", "end", "text"])

    return chunks.select(*keys, "rate", "samples").mapInPandas(run, f"{types}, n int, start double, end double, text string")

"""From sound to segments: voice activity, chunks, a speech model, times on the recording's own line.

Two ways, as recognisers need them. ``packed``: speech is put together without its pauses, cut into chunks of a fixed
length, and what the model says is put back where it was said. ``plain``: speech windows are put into chunks, each decoded
from a little before its start, and words said twice at the edge are trimmed.

Channels are rows (keys, offset, samples at 16 kHz); a channel must fit in a worker, as a file does. Only the chunks of
one channel are in a task at a time. Channels without speech give no segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxframe.functions import fixed_values as V
from voxframe.functions import text as T
from voxframe.functions.lazy import bounded
from voxframe.operators import folds, model_seam, signal, vad
from voxframe.operators import segments as G

RATE = model_seam.RATE
FRAME_SECONDS = 0.05
KEYS = ["recording", "speaker"]
_CHUNK = "recording string, speaker string, chunk int, chunk_start double, chunk_end double, rate int, samples array<float>"


def channels(audio: DataFrame, columns: dict[str, str]) -> DataFrame:
    """audio (name, rate, offset, channel columns) -> recording, speaker, offset, samples at 16 kHz. columns: by speaker."""
    bounded(audio.sparkSession)
    schema = StructType.fromDDL("recording string, speaker string, offset double, samples array<float>")
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select(["name", "rate", "offset"]).to_pylist()):
                for speaker, column in columns.items():
                    x = signal.resample(signal._samples(batch, column, i), row["rate"], RATE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["name"]]), pa.array([speaker]), pa.array([row["offset"]], pa.float64()),
                         pa.array([x.astype(np.float32)], pa.list_(pa.float32()))], schema=target)

    return audio.select("name", "rate", "offset", *columns.values()).mapInArrow(run, schema)


def speech(sound: DataFrame) -> DataFrame:
    """recording, speaker, start, end, duration (of the channel) of speech windows, from frames of 50 ms."""
    length = F.size("samples") / F.lit(float(RATE))
    frames = sound.select(*KEYS, length.alias("duration"), signal.frame_energy("samples", F.lit(RATE)).alias("energies"))
    frames = frames.select(*KEYS, "duration", F.posexplode("energies").alias("frame", "energy"))
    return vad.speech_windows(frames.withColumn("time", F.col("frame") * FRAME_SECONDS), [*KEYS, "duration"], FRAME_SECONDS)


def _chunks(sound: DataFrame, spans: DataFrame, cut: Callable[[np.ndarray, list[dict]], Iterator[tuple]]) -> DataFrame:
    """Sound in chunks: cut gives (start, end, samples) from a channel's samples and its spans in order."""
    bounded(sound.sparkSession)
    schema = StructType.fromDDL(_CHUNK)
    target = to_arrow_schema(schema)
    listed = spans.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(*[c for c in spans.columns if c not in KEYS]))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.select([*KEYS, "spans"]).to_pylist()):
                for k, (start, end, x) in enumerate(cut(signal._samples(batch, "samples", i), row["spans"])):
                    own = [pa.array([row[c]]) for c in KEYS]
                    place = [pa.array([k], pa.int32()), pa.array([start], pa.float64()), pa.array([end], pa.float64()), pa.array([RATE], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*own, *place, pa.array([x.astype(np.float32)], pa.list_(pa.float32()))], schema=target)

    return sound.select(*KEYS, "samples").join(listed, KEYS).select(*KEYS, "spans", "samples").mapInArrow(run, schema)


def packed_chunks(sound: DataFrame, packed: DataFrame, seconds: float) -> DataFrame:
    """Chunks of packed speech; chunk_start and chunk_end are times in it. packed: of ``segments.packed_map``."""
    size = int(seconds * RATE)
    if size < 1:
        raise ValueError("chunks hold a sample at least")

    def cut(x: np.ndarray, parts: list[dict]) -> Iterator[tuple]:
        whole = np.zeros(round(max(p["packed_end"] for p in parts) * RATE))
        for p in parts:
            at, a, n = round(p["packed_start"] * RATE), int(p["original_start"] * RATE), round((p["packed_end"] - p["packed_start"]) * RATE)
            piece = x[a : a + n]
            whole[at : at + len(piece)] = piece
        for at in range(0, len(whole), size):
            piece = whole[at : at + size]
            yield at / RATE, (at + len(piece)) / RATE, piece

    return _chunks(sound, packed.select(*KEYS, "packed_start", "packed_end", "original_start"), cut)


def plain_chunks(sound: DataFrame, spans: DataFrame) -> DataFrame:
    """Chunks (start, end) of a channel, with the sound from decode_start on."""

    def cut(x: np.ndarray, rows: list[dict]) -> Iterator[tuple]:
        for r in rows:
            piece = x[int(r["decode_start"] * RATE) : int(r["end"] * RATE)]
            if len(piece):
                yield r["start"], r["end"], piece

    return _chunks(sound, spans.select(*KEYS, "start", "end", "decode_start"), cut)


def by_packed_speech(sound: DataFrame, load: Callable, seconds: float = V.PACKED_CHUNK_SECONDS, options: dict | None = None) -> DataFrame:
    """recording, speaker, seq, start, end, text of whole files: load() gives (samples, rate, **options) -> text or
    segments of start, end and text within the chunk."""
    parts = G.vad_parts(speech(sound))
    packed = G.packed_map(parts, KEYS, RATE)
    said = model_seam.transcribe_segments(packed_chunks(sound, packed, seconds), [*KEYS, "chunk", "chunk_start", "chunk_end"], load, RATE, options)
    said = said.withColumn("id", F.struct("chunk", "n")).join(sound.select(*KEYS, F.col("offset").alias("base")), KEYS)
    placed = G.packed_to_absolute(said, packed, KEYS)
    return placed.select(*KEYS, (F.col("id.chunk").cast("long") * 1_000_000 + F.col("id.n")).alias("seq"), "start", "end", "text")


def by_chunks(sound: DataFrame, load: Callable, seconds: float = V.PLAIN_CHUNK_SECONDS, shift: float = V.CHUNK_BACKSHIFT_SECONDS, options: dict | None = None) -> DataFrame:
    """The same by chunks of speech windows, a segment each; words said again after an edge are trimmed."""
    spans = G.backshift(folds.pack_windows(speech(sound), KEYS, seconds), KEYS, shift)
    said = model_seam.transcribe(plain_chunks(sound, spans), [*KEYS, "chunk", "chunk_start", "chunk_end"], load, RATE, options)
    rows = said.join(sound.select(*KEYS, F.col("offset").alias("base")), KEYS).withColumn("text", T.clean_segment(F.col("text")))
    rows = rows.select(*KEYS, F.col("chunk").cast("long").alias("seq"), (F.col("base") + F.col("chunk_start")).alias("start"), (F.col("base") + F.col("chunk_end")).alias("end"), "text")
    return folds.trim_boundaries(rows.where("text <> ''"), KEYS)


def greedy_ctc(logits: np.ndarray, labels: list[str], blank: int = 0, delimiter: str = "|") -> str:
    """A path's best labels, repeats and blanks left out; the delimiter parts words."""
    best = np.asarray(logits).argmax(-1)
    kept = best[np.concatenate([[True], best[1:] != best[:-1]])] if len(best) else best
    return " ".join("".join(labels[i] for i in kept if i != blank).replace(delimiter, " ").split())


def ctc_decoder(labels: list[str], build: Callable[[], Callable[[np.ndarray], str]] | None = None, blank: int = 0) -> tuple[Callable[[np.ndarray], str], bool, str]:
    """(decode, whether a language model is used, message). build() makes a decoder with a language model; where there is
    none, or it can't be made because its library or files are missing, the best path is taken."""
    greedy = lambda logits: greedy_ctc(logits, labels, blank)
    if build is None:
        return greedy, False, "no language model; best path"
    try:
        return build(), True, "language model in use"
    except (ImportError, OSError) as e:
        return greedy, False, f"language model not usable ({e}); best path"

"""Signal operators: frame statistics as DataFrames, whole-recording transforms as Arrow-batched numpy.

Audio columns are arrays of float samples, one row per recording (or chunk); a recording must fit in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from voxframe.functions import frames as S
from voxframe.functions.lazy import bounded, pandas_udf

LUFS_TARGET = -23.0


# ---- frames ------------------------------------------------------------------------------------------------------------


def stereo_statistics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs has left and right -> a struct of levels, correlation and the side-to-mid ratio."""
    left, right = S.doubles(F.col("left")), S.doubles(F.col("right"))
    rows = pairs.select(*keys, left.alias("left"), right.alias("right")).withColumn("mid", S.mid(F.col("left"), F.col("right"))).withColumn("side", S.side(F.col("left"), F.col("right")))
    level = {f"{c}_{name}": f(F.col(c)) for c in ("left", "right", "mid", "side") for name, f in (("rms", S.rms), ("peak", S.peak))}
    out = rows.select(*keys, *[v.alias(k) for k, v in level.items()], S.correlation(F.col("left"), F.col("right")).alias("correlation"))
    return out.withColumn("side_to_mid_db", S.to_db(F.col("side_rms")) - S.to_db(F.col("mid_rms")))


def shared_peak_gain(pairs: DataFrame, recording: str) -> DataFrame:
    """One gain per recording for both channels, from the highest peak of all its frames."""
    p = F.greatest(S.peak(S.doubles(F.col("left"))), S.peak(S.doubles(F.col("right"))))
    return pairs.groupBy(recording).agg(F.max(p).alias("peak")).select(recording, "peak", S.peak_gain(F.col("peak")).alias("gain"))


def crosstalk_mask(energies: DataFrame, keys: list[str], alpha: float = 1.75, window: int = 5) -> DataFrame:
    """energies: keys, frame, left, right -> keep_left, keep_right in 0..1: a channel is kept in frames in which it is over
    alpha times as strong as the other; smoothed over ``window`` frames, beyond the ends counted as 0."""
    half = window // 2
    by = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-half, half)
    on = lambda a, b: F.when(F.col(a) > alpha * F.col(b), 1.0).otherwise(0.0)
    rows = energies.withColumn("_l", on("left", "right")).withColumn("_r", on("right", "left"))
    return rows.select(*keys, "frame", (F.sum("_l").over(by) / window).alias("keep_left"), (F.sum("_r").over(by) / window).alias("keep_right"))


# ---- whole recordings --------------------------------------------------------------------------------------------------


def resample(x: np.ndarray, rate: int, target: int = 16000) -> np.ndarray:
    """Linear interpolation onto round(duration * target) samples."""
    if rate == target or not len(x):
        return x
    n = round(len(x) / rate * target)
    if n <= 1:
        return np.zeros(0, np.float32)
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x).astype(np.float32)


def _biquad(x: np.ndarray, b: tuple, a: tuple) -> np.ndarray:
    """A second-order filter, run as blocks: the recursion's response to its two states is applied to a block at once."""
    n, block = len(x), 4096
    drive = b[0] * x
    drive[1:] += b[1] * x[:-1]
    drive[2:] += b[2] * x[:-2]
    # impulse response of 1 / A(z) and responses to the two past outputs
    h = np.zeros(block)
    h[0] = 1
    for i in range(1, block):
        h[i] = -a[1] * h[i - 1] - (a[2] * h[i - 2] if i > 1 else 0)
    one, two = -a[1] * h - a[2] * np.concatenate([[0], h[:-1]]), -a[2] * h
    size = 2 * block
    spectrum = np.fft.rfft(h, size)
    y, p, q = np.empty(n), 0.0, 0.0
    for at in range(0, n, block):
        part = drive[at : at + block]
        out = np.fft.irfft(np.fft.rfft(part, size) * spectrum, size)[: len(part)] + one[: len(part)] * p + two[: len(part)] * q
        y[at : at + len(part)] = out
        p, q = out[-1], out[-2] if len(out) > 1 else p
    return y


def k_weighting(rate: int) -> list[tuple[tuple, tuple]]:
    """The two filters of ITU-R BS.1770 at any rate: a high shelf and a high pass."""
    out = []
    for kind, gain, q, f in (("shelf", 3.999843853973347, 0.7071752369554196, 1681.974450955533), ("pass", 0.0, 0.5003270373238773, 38.13547087602444)):
        k = np.tan(np.pi * f / rate)
        d = 1 + k / q + k * k
        a = (1.0, 2 * (k * k - 1) / d, (1 - k / q + k * k) / d)
        if kind == "shelf":
            vh = 10 ** (gain / 20)
            vb = vh**0.4996667741545416
            b = ((vh + vb * k / q + k * k) / d, 2 * (k * k - vh) / d, (vh - vb * k / q + k * k) / d)
        else:
            b = (1.0, -2.0, 1.0)
        out.append((b, a))
    return out


def integrated_lufs(channels: list[np.ndarray], rate: int) -> float | None:
    """Gated loudness of BS.1770; None if shorter than a block or silent."""
    size, hop = int(0.4 * rate), int(0.1 * rate)
    if not channels or len(channels[0]) < size:
        return None
    powers = []
    for x in channels:
        y = x.astype(np.float64)
        for b, a in k_weighting(rate):
            y = _biquad(y, b, a)
        total = np.concatenate([[0], np.cumsum(y * y)])
        starts = np.arange(0, len(y) - size + 1, hop)
        powers.append((total[starts + size] - total[starts]) / size)
    z = np.sum(powers, 0)
    with np.errstate(divide="ignore"):
        loud = -0.691 + 10 * np.log10(z)
    kept = z[loud > -70]
    if not len(kept):
        return None
    kept = z[(loud > -70) & (loud > -0.691 + 10 * np.log10(kept.mean()) - 10)]
    return float(-0.691 + 10 * np.log10(kept.mean())) if len(kept) else None


def stft(x: np.ndarray, size: int = 2048) -> np.ndarray:
    """Hann windows of ``size`` with half overlap, zeros beyond the ends."""
    hop, window = size // 2, np.hanning(size + 1)[:-1]
    padded = np.concatenate([np.zeros(hop), x, np.zeros(hop + (-len(x)) % hop)])
    index = np.arange(size)[None] + hop * np.arange(1 + (len(padded) - size) // hop)[:, None]
    return np.fft.rfft(padded[index] * window, axis=1).T


def istft(z: np.ndarray, length: int, size: int = 2048) -> np.ndarray:
    hop, window = size // 2, np.hanning(size + 1)[:-1]
    parts = np.fft.irfft(z.T, size, axis=1) * window
    out, norm = np.zeros(hop * (len(parts) - 1) + size), np.zeros(hop * (len(parts) - 1) + size)
    for k, p in enumerate(parts):
        out[k * hop : k * hop + size] += p
        norm[k * hop : k * hop + size] += window**2
    return (out / np.maximum(norm, 1e-10))[hop : hop + length]


def suppress_crosstalk(left: np.ndarray, right: np.ndarray, alpha: float = 1.75, window: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each channel fades out of frames that it does not dominate."""
    zl, zr = stft(left), stft(right)
    el, er = np.abs(zl).sum(0), np.abs(zr).sum(0)
    half = window // 2
    smooth = lambda m: np.convolve(m, np.ones(window) / window)[half : half + len(m)]
    keep_l, keep_r = smooth(1.0 * (el > alpha * er)), smooth(1.0 * (er > alpha * el))
    return tuple(np.clip(istft(z * m, len(x)), -1, 1) for z, m, x in ((zl, keep_l, left), (zr, keep_r, right)))


def level(left: np.ndarray, right: np.ndarray, rate: int, target: float = LUFS_TARGET, top: float = S.TARGET_PEAK) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(left, right, loudness gain, peak gain): offsets removed, one gain to the loudness target but not over full scale,
    then one to the peak target."""
    left, right = left - left.mean(), right - right.mean()
    loud = integrated_lufs([left, right], rate)
    p = max(np.abs(left).max(), np.abs(right).max())
    gain = 1.0 if loud is None else 10 ** ((target - loud) / 20)
    if p * gain > 1:
        gain = 1 / p
    p *= gain
    second = min(1.0, top / p) if p > 1e-9 else 1.0
    return left * gain * second, right * gain * second, float(gain), float(second)


#: Figures of a levelled recording, in order: gains, then levels in dB, correlations and loudness before and after.
FIGURES = [
    "lufs_gain", "peak_gain", "total_gain", "correlation_before", "correlation_after", "left_before", "left_after",
    "right_before", "right_after", "left_peak_before", "left_peak_after", "right_peak_before", "right_peak_after",
    "mid_before", "mid_after", "side_before", "side_after", "side_to_mid_before", "side_to_mid_after",
    "lufs_before", "lufs_after", "mid_lufs_before", "mid_lufs_after", "side_lufs_before", "side_lufs_after",
]


def _db(x: float) -> float:
    return 20 * float(np.log10(max(x, S.FLOOR)))


def _rms(x: np.ndarray) -> float:
    return float(np.sqrt(np.mean(x * x)))


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    sa, sb = a.std(), b.std()
    return 0.0 if min(sa, sb) <= S.FLOOR else float(((a - a.mean()) * (b - b.mean())).mean() / (sa * sb))


def stereo_figures(before: tuple, after: tuple, rate: int, gain: float, second: float) -> dict[str, float | None]:
    """FIGURES of (left, right) before and after levelling."""
    out: dict[str, float | None] = {"lufs_gain": gain, "peak_gain": second, "total_gain": gain * second}
    for when, (left, right) in (("before", before), ("after", after)):
        mid, side = 0.5 * (left + right), 0.5 * (left - right)
        out[f"correlation_{when}"] = _correlation(left, right)
        for name, x in (("left", left), ("right", right), ("mid", mid), ("side", side)):
            out[f"{name}_{when}"] = _db(_rms(x))
        for name, x in (("left", left), ("right", right)):
            out[f"{name}_peak_{when}"] = _db(float(np.abs(x).max()))
        out[f"side_to_mid_{when}"] = _db(_rms(side) / max(_rms(mid), S.FLOOR))
        for name, channels in (("lufs", [left, right]), ("mid_lufs", [mid]), ("side_lufs", [side])):
            out[f"{name}_{when}"] = integrated_lufs(channels, rate)
    return out


def _samples(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    """One row's samples, without Python numbers in between; null is none."""
    value = batch.column(batch.schema.get_field_index(name))[row].values
    return np.zeros(0) if value is None else value.to_numpy(zero_copy_only=False).astype(np.float64)


def process_stereo(audio: DataFrame, keys: list[str]) -> DataFrame:
    """audio: keys, rate, left, right -> levelled channels, their mix, and FIGURES (null for recordings without samples)."""
    bounded(audio.sparkSession)
    own = audio.select(*keys, "rate", "left", "right")
    fields = [own.schema[k] for k in keys]
    arrays = [StructField(c, ArrayType(FloatType())) for c in ("left", "right", "mix")]
    schema = StructType([*fields, *arrays, *[StructField(c, DoubleType()) for c in FIGURES]])
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = _samples(batch, "left", i), _samples(batch, "right", i)
                figures: dict[str, float | None] = {"lufs_gain": 1.0, "peak_gain": 1.0, "total_gain": 1.0}
                a, b = left, right
                if len(left):
                    rate = int(batch.column(len(keys))[i].as_py())
                    a, b, gain, second = level(left, right, rate)
                    figures = stereo_figures((left, right), (a, b), rate, gain, second)
                sound = [pa.array([x.astype(np.float32)], pa.list_(pa.float32())) for x in (a, b, 0.5 * (a + b))]
                numbers = [pa.array([figures.get(c)], pa.float64()) for c in FIGURES]
                columns = [batch.column(k).slice(i, 1) for k in range(len(keys))] + sound + numbers
                yield pa.RecordBatch.from_arrays(columns, names=target.names)

    return own.mapInArrow(run, schema)


def clean_stereo(audio: DataFrame, keys: list[str], alpha: float = 1.75) -> DataFrame:
    """audio: keys, left, right -> both without crosstalk."""
    bounded(audio.sparkSession)
    own = audio.select(*keys, "left", "right")
    arrays = [StructField(c, ArrayType(FloatType())) for c in ("left", "right")]
    schema = StructType([*[own.schema[k] for k in keys], *arrays])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                l, r = _samples(batch, "left", i), _samples(batch, "right", i)
                both = suppress_crosstalk(l, r, alpha) if len(l) else (l, r)
                sound = [pa.array([x.astype(np.float32)], pa.list_(pa.float32())) for x in both]
                kept = [batch.column(k).slice(i, 1) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*kept, *sound], names=schema.names)

    return own.mapInArrow(run, schema)


@pandas_udf("array<float>")
def resampled(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([resample(np.asarray(x, np.float64), int(r)).tolist() for x, r in zip(samples, rate)])


@pandas_udf("array<double>")
def frame_energy(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Energy in dB of frames of 50 ms, of samples as 16-bit integers."""
    out = []
    for x, r in zip(samples, rate):
        size = max(1, int(0.05 * int(r)))
        x = np.round(np.clip(np.asarray(x, np.float64), -1, 1) * 32767)
        x = np.concatenate([x, np.zeros((-len(x)) % size)]).reshape(-1, size)
        out.append((10 * np.log10(np.maximum((x**2).mean(1), 1e-10))).tolist())
    return pd.Series(out)

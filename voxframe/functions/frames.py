"""Signal arithmetic on arrays of samples as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12
TARGET_PEAK = 0.95


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def mean(c: Column) -> Column:
    return F.when(F.size(c) > 0, _sum(c) / F.size(c))


def rms(c: Column) -> Column:
    return F.sqrt(_sum(F.transform(c, lambda x: x * x)) / F.size(c))


def peak(c: Column) -> Column:
    return F.array_max(F.transform(c, F.abs))


def to_db(c: Column) -> Column:
    return 20 * F.log10(F.greatest(c, F.lit(FLOOR)))


def remove_dc(c: Column) -> Column:
    m = mean(c)
    return F.transform(c, lambda x: x - m)


def mid(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: 0.5 * (a + b))


def side(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: 0.5 * (a - b))


def scale(c: Column, gain: Column) -> Column:
    return F.transform(c, lambda x: x * gain)


def correlation(left: Column, right: Column) -> Column:
    """Pearson's, 0 where either side doesn't move."""
    n = F.size(left)
    ml, mr = mean(left), mean(right)
    cov = _sum(F.zip_with(left, right, lambda a, b: (a - ml) * (b - mr))) / n
    sl = F.sqrt(_sum(F.transform(left, lambda a: (a - ml) * (a - ml))) / n)
    sr = F.sqrt(_sum(F.transform(right, lambda b: (b - mr) * (b - mr))) / n)
    return F.when((sl <= FLOOR) | (sr <= FLOOR), 0.0).otherwise(cov / (sl * sr))


def peak_gain(p: Column, target: float = TARGET_PEAK) -> Column:
    """The factor that brings a peak down to the target; 1 for silence and for what is low enough."""
    return F.when(p <= 1e-9, 1.0).otherwise(F.least(F.lit(1.0), F.lit(target) / p))


def pcm_to_float(c: Column, width: int) -> Column:
    """Integer samples of 1 (unsigned, centred at 128), 2 or 4 bytes as -1..1."""
    if width == 1:
        return F.transform(c, lambda x: (x.cast("double") - 128) / 128)
    return F.transform(c, lambda x: x.cast("double") / float(1 << (8 * width - 1)))


def float_to_pcm(c: Column, width: int = 2) -> Column:
    top = float((1 << (8 * width - 1)) - 1)
    return F.transform(c, lambda x: F.bround(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x)) * top, 0).cast("int"))

"""Queries of the signal operators, on pairs of embeddings as stereo frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import frames as S
from voxframe.operators import model_seam, signal
from voxframe.plans import reports
from voxframe.plans.inputs import STEREO, stereo, table


def rms_dbfs(spark: SparkSession, d: str) -> DataFrame:
    x = S.doubles(F.col("embedding"))
    rows = table(spark, d, "embeddings").select("vec_id", S.rms(x).alias("rms"), S.peak(x).alias("peak"), S.rms(S.remove_dc(x)).alias("ac"))
    return rows.select("vec_id", F.round("rms", 9).alias("rms"), F.round("peak", 9).alias("peak"), F.round("ac", 9).alias("ac_rms"), F.round(S.to_db(F.col("rms")), 6).alias("db"))


def stereo_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = signal.stereo_statistics(stereo(spark, d), ["recording", "frame"])
    return rows.select("recording", "frame", *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


def peak_gain(spark: SparkSession, d: str) -> DataFrame:
    loud = stereo(spark, d).withColumn("left", F.transform("left", lambda x: x * 3.0))
    rows = signal.shared_peak_gain(loud, "recording")
    return rows.select("recording", F.round("peak", 6).alias("peak"), F.round("gain", 6).alias("gain"))


def energy_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = stereo(spark, d)
    energy = lambda c: F.aggregate(F.transform(S.doubles(F.col(c)), F.abs), F.lit(0.0), lambda s, x: s + x)
    out = signal.crosstalk_mask(rows.select("recording", "frame", energy("left").alias("left"), energy("right").alias("right")), ["recording"], alpha=1.02)
    return out.select("recording", "frame", F.round("keep_left", 6).alias("keep_left"), F.round("keep_right", 6).alias("keep_right"))


def pcm_round_trip(spark: SparkSession, d: str) -> DataFrame:
    x = S.doubles(F.col("embedding"))
    pcm = S.float_to_pcm(S.scale(x, F.lit(2.0)))
    rows = table(spark, d, "embeddings").select("vec_id", pcm.alias("pcm"))
    back = S.pcm_to_float(F.col("pcm"), 2)
    return rows.select("vec_id", F.aggregate("pcm", F.lit(0), lambda s, v: s + v).alias("total"), F.array_max("pcm").alias("top"), F.round(S.peak(back), 6).alias("peak"))


def _audio(spark: SparkSession, d: str) -> DataFrame:
    """Twenty frames in a row, as sound of 1.6 seconds at 800 Hz: recordings whose length does not grow with the table."""
    rows = stereo(spark, d).withColumn("recording", F.floor(F.col("frame") / 20))
    parts = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame", c))), lambda x: x[c]))
    return rows.groupBy("recording").agg(parts("left").alias("left"), parts("right").alias("right")).withColumn("rate", F.lit(800))


def _digest(c: str):
    """Values of an array of samples in one number, each weighted by its place."""
    terms = F.transform(S.doubles(F.col(c)), lambda x, i: x * ((i % 97) + 1))
    return F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 3).alias(f"{c}_digest")


def processed_stereo(spark: SparkSession, d: str) -> DataFrame:
    done = signal.process_stereo(_audio(spark, d), ["recording"])
    return done.select("recording", *map(_digest, ("left", "right", "mix")), *[F.round(c, 4).alias(c) for c in signal.FIGURES])


def cleaned_stereo(spark: SparkSession, d: str) -> DataFrame:
    done = signal.clean_stereo(_audio(spark, d), ["recording"], alpha=1.02)
    return done.select("recording", F.size("left").alias("n"), *map(_digest, ("left", "right")))


def resampled(spark: SparkSession, d: str) -> DataFrame:
    """Values of frames taken for 8 kHz, at 16 kHz."""
    x = signal.resampled("embedding", F.lit(8000))
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(x).alias("at", "x")).select("vec_id", "at", F.round(F.col("x").cast("double"), 5).alias("x"))


def transcribed(spark: SparkSession, d: str) -> DataFrame:
    """The model seam with a stand-in that says which of the samples it was given is the highest, and how many there are."""
    rows = table(spark, d, "embeddings").select("vec_id", F.lit(16000).alias("rate"), F.col("embedding").alias("samples"))
    return model_seam.transcribe(rows, ["vec_id"], lambda: lambda x, rate: f"{max(range(len(x)), key=x.__getitem__)} of {len(x)} at {rate}")


def signal_report(spark: SparkSession, d: str) -> DataFrame:
    """A report per recording over all its frames."""
    rows = signal.process_stereo(_audio(spark, d), ["recording", "rate"])
    figures = rows.withColumn("source", F.concat(F.col("recording").cast("string"), F.lit(".wav"))).withColumn("n", F.size("mix"))
    return reports.signal_report(figures, ["recording"])


QUERIES = {f.__name__: f for f in (rms_dbfs, stereo_statistics, peak_gain, energy_mask, pcm_round_trip, processed_stereo, cleaned_stereo, resampled, transcribed, signal_report)}

_rms = lambda x: f"sqrt(list_sum(list_transform({x}, lambda v: v * v)) / len({x}))"
_peak = lambda x: f"list_max(list_transform({x}, lambda v: abs(v)))"
_std = lambda x: f"sqrt(list_sum(list_transform({x}, lambda v: (v - list_avg({x})) * (v - list_avg({x})))) / len({x}))"

ORACLE_SQL = {
    "rms_dbfs": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, round({_rms('x')}, 9) AS rms, round({_peak('x')}, 9) AS peak, round({_std('x')}, 9) AS ac_rms, round(20 * log10(greatest({_rms('x')}, 1e-12)), 6) AS db FROM e""",
    "stereo_statistics": f"""WITH {STEREO}, m AS (SELECT *, list_transform(range(1, len(l) + 1), lambda i: 0.5 * (l[i] + r[i])) AS mid, list_transform(range(1, len(l) + 1), lambda i: 0.5 * (l[i] - r[i])) AS side, list_avg(l) AS ml, list_avg(r) AS mr FROM stereo)
SELECT recording, frame, round({_rms('l')}, 6) AS left_rms, round({_peak('l')}, 6) AS left_peak, round({_rms('r')}, 6) AS right_rms, round({_peak('r')}, 6) AS right_peak, round({_rms('mid')}, 6) AS mid_rms, round({_peak('mid')}, 6) AS mid_peak,
  round({_rms('side')}, 6) AS side_rms, round({_peak('side')}, 6) AS side_peak, round(list_sum(list_transform(range(1, len(l) + 1), lambda i: (l[i] - ml) * (r[i] - mr))) / len(l) / ({_std('l')} * {_std('r')}), 6) AS correlation,
  round(20 * log10({_rms('side')}) - 20 * log10({_rms('mid')}), 6) AS side_to_mid_db FROM m""",
    "peak_gain": f"""WITH {STEREO}, p AS (SELECT recording, max(greatest(3 * {_peak('l')}, {_peak('r')})) AS peak FROM stereo GROUP BY recording) SELECT recording, round(peak, 6) AS peak, round(least(1.0, 0.95 / peak), 6) AS gain FROM p""",
    "energy_mask": f"""WITH {STEREO}, e AS (SELECT recording, frame, list_sum(list_transform(l, lambda v: abs(v))) AS l, list_sum(list_transform(r, lambda v: abs(v))) AS r FROM stereo),
k AS (SELECT recording, frame, CASE WHEN l > 1.02 * r THEN 1.0 ELSE 0.0 END AS l, CASE WHEN r > 1.02 * l THEN 1.0 ELSE 0.0 END AS r FROM e)
SELECT recording, frame, round(CAST(sum(l) OVER w AS DOUBLE) / 5, 6) AS keep_left, round(CAST(sum(r) OVER w AS DOUBLE) / 5, 6) AS keep_right FROM k WINDOW w AS (PARTITION BY recording ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "pcm_round_trip": """WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(round_even(least(CAST(1 AS DOUBLE), greatest(CAST(-1 AS DOUBLE), CAST(v AS DOUBLE) * 2)) * 32767, 0) AS INTEGER)) AS x FROM embeddings)
SELECT vec_id, CAST(list_sum(x) AS INTEGER) AS total, list_max(x) AS top, round(list_max(list_transform(x, lambda v: abs(v) / CAST(32768 AS DOUBLE))), 6) AS peak FROM p""",
    "resampled": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, len(embedding) AS n FROM embeddings),
p AS (SELECT vec_id, x, n, unnest(range(0, 2 * n)) AS k FROM e), q AS (SELECT *, k * CAST(n - 1 AS DOUBLE) / (2 * n - 1) AS t FROM p)
SELECT vec_id, CAST(k AS INTEGER) AS "at", round(CAST(CAST(x[CAST(floor(t) AS INTEGER) + 1] + (t - floor(t)) * (x[least(CAST(floor(t) AS INTEGER) + 2, n)] - x[CAST(floor(t) AS INTEGER) + 1]) AS FLOAT) AS DOUBLE), 5) AS x FROM q""",
    "transcribed": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1) || ' of ' || len(embedding) || ' at 16000' AS text FROM embeddings",
}

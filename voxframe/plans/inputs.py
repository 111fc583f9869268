"""Inputs of the registered queries, made from the generic tables; each with the SQL that makes the same rows.

Conversations stand for recordings: a turn is a segment, users interview, assistants answer. Times lie on a grid of
tenths of a second, with overlaps. Events stand for speech activity, pairs of embeddings for stereo frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "interviewer").when(F.col("role") == "assistant", "interviewee").otherwise(F.col("role"))
    text = F.replace("text", F.lit("\n"), F.lit(" "))
    return rows.select(
        F.col("conv_id").cast("string").alias("recording"), F.col("turn").cast("int").alias("seq"), F.format_string("seg_%d_%05d", "conv_id", F.col("turn") + 1).alias("id"), role.alias("speaker"),
        (F.col("turn") * 4.0).alias("start"), (F.col("turn") * 4.0 + 0.5 + (F.length("text") % 45) / 10.0).alias("end"), text.alias("text"),
    )


SEGMENTS = """segments AS (SELECT CAST(conv_id AS VARCHAR) AS recording, CAST(turn AS INTEGER) AS seq, format('seg_{}_{:05d}', conv_id, turn + 1) AS id,
  CASE role WHEN 'user' THEN 'interviewer' WHEN 'assistant' THEN 'interviewee' ELSE role END AS speaker,
  turn * CAST(4.0 AS DOUBLE) AS start, turn * CAST(4.0 AS DOUBLE) + CAST(0.5 AS DOUBLE) + CAST(length(text) % 45 AS DOUBLE) / CAST(10.0 AS DOUBLE) AS "end", replace(text, chr(10), ' ') AS text FROM conversations)"""


def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, seq, speaker, ref, hyp: a turn's words, and the same with every seventh one lost and others misheard."""
    rows = segments(spark, sf_dir).select("recording", "seq", "speaker", T.tokens(T.normalize_for_dedup(F.col("text"))).alias("ref"))
    heard = F.transform(F.filter(F.transform("ref", lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i"))), lambda x: x["i"] % 7 != 3), lambda x: F.when(x["i"] % 11 == 5, F.lit("zz")).otherwise(x["w"]))
    return rows.withColumn("hyp", heard)


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def tokens_sql(x: str) -> str:
    """Words of a text that is normalised already."""
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


WORD_PAIRS = f"""{SEGMENTS},
refs AS (SELECT recording, seq, speaker, {tokens_sql(norm_sql("text"))} AS ref FROM segments),
pairs AS (SELECT *, list_transform(list_filter(range(1, len(ref) + 1), lambda i: i % 7 <> 3), lambda i: CASE WHEN i % 11 = 5 THEN 'zz' ELSE ref[i] END) AS hyp FROM refs)"""

# distances of all pairs, a row of the matrix at a time: the running minimum of (candidate - place) gives a whole row
DISTANCES = f"""{WORD_PAIRS},
dp(recording, seq, i, d) AS (
  SELECT recording, seq, 0, range(0, len(hyp) + 1) FROM pairs
  UNION ALL
  SELECT dp.recording, dp.seq, i + 1, list_prepend(i + 1, list_transform(range(1, len(hyp) + 1), lambda j: j + least(i + 1, list_min(list_transform(range(1, j + 1), lambda k: least(d[k + 1] + 1, d[k] + CASE WHEN hyp[k] = ref[i + 1] THEN 0 ELSE 1 END) - k)))))
  FROM dp JOIN pairs USING (recording, seq) WHERE i < len(ref))"""


def alignment_sql(source: str, p: str = "") -> str:
    """CTEs that end in {p}chunks (recording, seq, op, rs, re, hs, he) of the pairs in ``source``.

    In the distance matrix of what common words at both ends leave, every cell names the step that leads back from it,
    deletion before insertion before the diagonal; the walk follows these from the last cell.
    """
    differ = lambda a, b: f"nullif(list_position({a}, true), 0) - 1, {b}"
    return f"""
{p}head AS (SELECT recording, seq, ref, hyp, least(len(ref), len(hyp)) AS n,
  coalesce({differ("list_transform(range(1, least(len(ref), len(hyp)) + 1), lambda i: ref[i] <> hyp[i])", "least(len(ref), len(hyp))")}) AS head FROM {source}),
{p}mid AS (SELECT recording, seq, head, tail, ref[head + 1 : len(ref) - tail] AS a, hyp[head + 1 : len(hyp) - tail] AS b FROM (SELECT *,
  coalesce({differ("list_transform(range(0, n - head), lambda i: ref[len(ref) - i] <> hyp[len(hyp) - i])", "n - head")}) AS tail FROM {p}head)),
{p}dp(recording, seq, i, d) AS (
  SELECT recording, seq, 0, range(0, len(b) + 1) FROM {p}mid
  UNION ALL
  SELECT x.recording, x.seq, i + 1, list_prepend(i + 1, list_transform(range(1, len(b) + 1), lambda j: j + least(i + 1,
    list_min(list_transform(range(1, j + 1), lambda k: least(d[k + 1] + 1, d[k] + CASE WHEN b[k] = a[i + 1] THEN 0 ELSE 1 END) - k)))))
  FROM {p}dp x JOIN {p}mid USING (recording, seq) WHERE i < len(a)),
{p}steps AS (SELECT x.recording, x.seq, x.i, array_to_string(list_transform(range(0, len(x.d)), lambda j: CASE WHEN x.i > 0 AND x.d[j + 1] = y.d[j + 1] + 1 THEN 'd'
  WHEN j > 0 AND x.d[j + 1] = x.d[j] + 1 THEN 'i' WHEN a[x.i] = b[j] THEN 'e' ELSE 's' END), '') AS c
  FROM {p}dp x JOIN {p}mid m ON m.recording = x.recording AND m.seq = x.seq LEFT JOIN {p}dp y ON y.recording = x.recording AND y.seq = x.seq AND y.i = x.i - 1),
{p}trace(recording, seq, k, i, j, op) AS (
  SELECT recording, seq, 0, CAST(len(a) AS BIGINT), CAST(len(b) AS BIGINT), '' FROM {p}mid
  UNION ALL
  SELECT recording, seq, k + 1, CASE WHEN o = 'i' THEN i ELSE i - 1 END, CASE WHEN o = 'd' THEN j ELSE j - 1 END, o FROM (
    SELECT t.recording, t.seq, k, t.i, j, substring(c, j + 1, 1) AS o FROM {p}trace t JOIN {p}steps x ON x.recording = t.recording AND x.seq = t.seq AND x.i = t.i WHERE t.i > 0 OR j > 0)),
{p}ops AS (SELECT *, row_number() OVER (PARTITION BY recording, seq ORDER BY part, n) AS pos FROM (
  SELECT recording, seq, 0 AS part, unnest(range(1, head + 1)) AS n, 'equal' AS op FROM {p}mid
  UNION ALL SELECT recording, seq, 1, -k, CASE op WHEN 'd' THEN 'delete' WHEN 'i' THEN 'insert' WHEN 'e' THEN 'equal' ELSE 'substitute' END FROM {p}trace WHERE k > 0
  UNION ALL SELECT recording, seq, 2, unnest(range(1, tail + 1)), 'equal' FROM {p}mid)),
{p}placed AS (SELECT *, count(*) FILTER (op <> 'insert') OVER w AS re, count(*) FILTER (op <> 'delete') OVER w AS he,
  pos - row_number() OVER (PARTITION BY recording, seq, op ORDER BY pos) AS island FROM {p}ops WINDOW w AS (PARTITION BY recording, seq ORDER BY pos)),
{p}chunks AS (SELECT recording, seq, op, min(re - CAST(op <> 'insert' AS INTEGER)) AS rs, max(re) AS re, min(he - CAST(op <> 'delete' AS INTEGER)) AS hs, max(he) AS he
  FROM {p}placed GROUP BY recording, seq, op, island),
{p}metrics AS (SELECT q.recording, q.seq, CAST(coalesce(sum(re - rs) FILTER (op = 'equal'), 0) AS INTEGER) AS hits, CAST(coalesce(sum(re - rs) FILTER (op = 'substitute'), 0) AS INTEGER) AS sub,
  CAST(coalesce(sum(he - hs) FILTER (op = 'insert'), 0) AS INTEGER) AS ins, CAST(coalesce(sum(re - rs) FILTER (op = 'delete'), 0) AS INTEGER) AS del,
  CASE WHEN any_value(len(ref)) > 0 THEN CAST(coalesce(sum(greatest(re - rs, he - hs)) FILTER (op <> 'equal'), 0) AS DOUBLE) / any_value(len(ref)) END AS wer,
  coalesce(string_agg(op || ' ' || rs || ' ' || re || ' ' || hs || ' ' || he, '|' ORDER BY re, he), '') AS chunks
  FROM {source} q LEFT JOIN {p}chunks c ON c.recording = q.recording AND c.seq = q.seq GROUP BY q.recording, q.seq)"""


ALIGNED = f"{WORD_PAIRS}, {alignment_sql('pairs')}"


def stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording, frame, left, right: embeddings 2k and 2k + 1."""
    rows = table(spark, sf_dir, "embeddings")
    a = rows.where("vec_id % 2 = 0").select(F.floor(F.col("vec_id") / 2).alias("frame"), F.col("embedding").alias("left"))
    b = rows.where("vec_id % 2 = 1").select(F.floor(F.col("vec_id") / 2).alias("frame"), F.col("embedding").alias("right"))
    return a.join(b, "frame").select((F.col("frame") % 10).alias("recording"), "frame", "left", "right")


STEREO = """stereo AS (SELECT a.vec_id // 2 % 10 AS recording, a.vec_id // 2 AS frame, CAST(a.embedding AS DOUBLE[]) AS l, CAST(b.embedding AS DOUBLE[]) AS r
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"""


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording (user), time (whole seconds since midnight), energy: events as frames of a second."""
    rows = table(spark, sf_dir, "events")
    seconds = F.unix_timestamp(F.date_trunc("second", "ts")) - F.unix_timestamp(F.date_trunc("day", "ts"))
    return rows.groupBy(F.col("user_id").alias("recording"), F.floor(seconds / 60).cast("double").alias("time")).agg((F.max(F.length("event_type")) * 8.0).alias("energy"))


ACTIVITY = """activity AS (SELECT user_id AS recording, CAST(floor((epoch(date_trunc('second', ts)) - epoch(date_trunc('day', ts))) / 60) AS DOUBLE) AS "time", max(length(event_type)) * CAST(8.0 AS DOUBLE) AS energy
  FROM events GROUP BY ALL)"""

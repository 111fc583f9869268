"""Queries of the segment operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import fixed_values as V
from voxframe.functions import text as T
from voxframe.operators import folds, vad
from voxframe.operators import segments as G
from voxframe.plans import fold_sql
from voxframe.plans.inputs import ACTIVITY, SEGMENTS, activity, norm_sql, segments, tokens_sql

LO, HI = 5.0, 13.25


def _truth(spark: SparkSession, d: str) -> DataFrame:
    """Segments of one or two speakers: system turns are said by both."""
    both = F.col("speaker") == "system"
    rows = segments(spark, d)
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.map_from_arrays(F.array(F.lit("interviewee"), F.lit("interviewer"), F.lit("guest")), F.array(F.substring("text", F.lit(1), half), F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)"), F.lit("aside")))
    return rows.select(
        "recording", "seq", F.format_string("seg_%05d", F.col("seq") + 1).alias("id"), F.when(both, F.array(F.lit("interviewer"), F.lit("interviewee"), F.lit("guest"))).otherwise(F.array("speaker")).alias("speakers"),
        "start", "end", "text", both.alias("is_overlap"), F.when(both, parts).alias("text_by_speaker"),
    )


def window_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d).withColumn("start", F.when(F.col("seq") != 5, F.col("start"))).withColumn("end", F.when(F.col("seq") != 2, F.col("end")))
    return rows.where(G.in_window(F.col("start"), F.col("end"), F.lit(LO), F.lit(HI))).select("recording", "seq")


def clip_by_ratio(spark: SparkSession, d: str) -> DataFrame:
    return segments(spark, d).select("recording", "seq", G.clip_by_ratio(F.col("text"), F.col("start"), F.col("end"), F.lit(LO), F.lit(HI)).alias("clipped"))


def window_text(spark: SparkSession, d: str) -> DataFrame:
    return G.window_text(segments(spark, d), ["recording"], F.lit(None).cast("double"), F.lit(HI))


def recording_filter(spark: SparkSession, d: str) -> DataFrame:
    """Two recordings in one file: ids name the even ones; for odd ones all segments count."""
    rows = segments(spark, d).withColumn("wanted", F.concat((F.floor(F.col("recording").cast("int") / 2) * 2).cast("string"))).withColumn("file", F.floor(F.col("recording").cast("int") / 4))
    return G.of_recording(rows.withColumn("id", F.when(F.col("file") % 3 != 0, F.col("id"))), "wanted", ["file"]).select("file", "recording", "seq", "fallback_used")


def full_reference(spark: SparkSession, d: str) -> DataFrame:
    full = F.when((F.col("seq") == 1) & (F.col("recording").cast("int") % 2 == 0), F.format_string("full_%s_transcript", "recording")).when(F.col("seq") == 0, F.lit("full_other_transcript")).otherwise(F.col("id"))
    return G.full_reference(segments(spark, d).withColumn("id", full), "recording")


def eval_reference(spark: SparkSession, d: str) -> DataFrame:
    out = G.eval_reference(_truth(spark, d), "recording")
    return out.select("recording", "seq", "id", F.array_join("speakers", "|").alias("speakers"), "start", "end", "text", "is_overlap", F.try_element_at("text_by_speaker", F.lit("interviewee")).alias("said_by_interviewee"))


def full_transcript(spark: SparkSession, d: str) -> DataFrame:
    return G.full_transcript(segments(spark, d), "recording").select("recording", "id", "start", "end", "text")


def speaker_summary(spark: SparkSession, d: str) -> DataFrame:
    return G.speaker_summary(_truth(spark, d), "recording")


def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d).withColumn("speakers", F.array("speaker"))
    again = rows.withColumn("seq", F.col("seq") + 100).withColumn("text", F.concat(F.lit("... "), "text"))
    return G.exact_dedup(rows.unionByName(again), ["recording"]).select("recording", "seq", "start", "end")


def formal_segments(spark: SparkSession, d: str) -> DataFrame:
    out = G.formal_segments(segments(spark, d).select("recording", "seq", "speaker", "text", F.round(F.col("start") + F.length("text") % 7, 3).alias("start")), "recording")
    return out.select("recording", "id", "seq", "start", "end", F.element_at("speakers", 1).alias("speaker"))


def default_duration(spark: SparkSession, d: str) -> DataFrame:
    return G.default_duration(segments(spark, d).withColumn("start", F.round(F.col("start") + F.length("text") % 7, 3)), "recording")


def part_offsets(spark: SparkSession, d: str) -> DataFrame:
    return G.part_offsets(segments(spark, d).withColumn("part", F.floor(F.col("seq") / 2)), "recording")


def make_segments(spark: SparkSession, d: str) -> DataFrame:
    """Two turns a piece: those of one role are one speaker's text."""
    events = segments(spark, d).withColumn("piece", F.floor(F.col("seq") / 2)).withColumn("start", F.floor(F.col("seq") / 2) * 8.0).withColumn("end", F.floor(F.col("seq") / 2) * 8.0 + 8.0)
    out = G.make_segments(events, ["recording"])
    return out.select("recording", "seq", "id", F.array_join("speakers", "|").alias("speakers"), "start", "end", "text", "is_overlap")


def enriched(spark: SparkSession, d: str) -> DataFrame:
    out = G.enrich(segments(spark, d), ["recording"], split=True)
    return out.select("recording", "id", "speaker", F.element_at("speakers", 1).alias("first"), "start", "end", "is_overlap")


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return vad.speech_windows(activity(spark, d), ["recording"], 1.0, threshold=40.0, max_silence=30.0, min_dur=0.25, max_dur=200.0)


_WINDOWS = f"""{ACTIVITY},
f AS (SELECT recording, "time" AS t FROM activity WHERE energy >= 40.0),
n AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - (lag(t) OVER w + 1.0) > 30.0 THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY recording ORDER BY t)),
i AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY t) AS island FROM n),
s AS (SELECT recording, min(t) AS a, max(t) + CAST(1.0 AS DOUBLE) AS b FROM i GROUP BY recording, island),
windows AS (SELECT recording, a + k * CAST(200.0 AS DOUBLE) AS start, least(b, a + (k + 1) * CAST(200.0 AS DOUBLE)) AS "end" FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((b - a) / CAST(200.0 AS DOUBLE)) AS INTEGER), 1))) AS k FROM s) WHERE least(b, a + (k + 1) * CAST(200.0 AS DOUBLE)) - (a + k * CAST(200.0 AS DOUBLE)) >= 0.25)"""


def vad_windows(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d)


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return G.vad_parts(_windows(spark, d).withColumn("start", F.col("start") - 10.0).withColumn("duration", F.lit(1300.0)))


_PARTS = f"""{_WINDOWS},
parts AS (SELECT recording, greatest(CAST(0.0 AS DOUBLE), start - CAST(10.0 AS DOUBLE)) AS start, least(CAST(1300.0 AS DOUBLE), "end") AS "end" FROM windows WHERE least(1300.0, "end") > greatest(0.0, start - 10.0)),
c AS (SELECT *, CAST(floor("end" * 16000) - floor(start * 16000) AS BIGINT) AS n, row_number() OVER (PARTITION BY recording ORDER BY start, "end") - 1 AS idx FROM parts),
packed AS (SELECT recording, CAST(idx AS INTEGER) AS idx, CAST(coalesce(sum(n) OVER (PARTITION BY recording ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + idx * 1600 AS DOUBLE) / CAST(16000.0 AS DOUBLE) AS packed_start, n, start AS original_start, "end" AS original_end FROM c WHERE n > 0),
pm AS (SELECT recording, idx, packed_start, packed_start + CAST(n AS DOUBLE) / CAST(16000.0 AS DOUBLE) AS packed_end, original_start, original_end FROM packed)"""


def vad_parts(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("recording", "start", "end")


def packed_part_map(spark: SparkSession, d: str) -> DataFrame:
    return G.packed_map(_parts(spark, d), ["recording"])


def packed_to_original(spark: SparkSession, d: str) -> DataFrame:
    offsets = activity(spark, d).select("recording", F.col("time").cast("long").alias("id"), (F.col("time") / 2.0 - 3.0).alias("offset"))
    return G.to_original(offsets, G.packed_map(_parts(spark, d), ["recording"]), ["recording"])


def packed_to_absolute(spark: SparkSession, d: str) -> DataFrame:
    """Segments of chunks of packed audio, some beyond their chunk, on the recording's line."""
    time = F.col("time")
    start = F.pmod(time, F.lit(50.0)) / 2.0 - 3.0
    said = activity(spark, d).select("recording", time.cast("long").alias("id"), start.alias("start"), (start + F.pmod(time, F.lit(7.0)) - 1.0).alias("end"),
                                     (F.floor(time / 60) * 20.0).alias("chunk_start"), (F.floor(time / 60) * 20.0 + 15.0).alias("chunk_end"), F.lit(100.0).alias("base"))
    return G.packed_to_absolute(said, G.packed_map(_parts(spark, d), ["recording"]), ["recording"]).select("recording", "id", "start", "end")


def vad_chunks(spark: SparkSession, d: str) -> DataFrame:
    return folds.pack_windows(_windows(spark, d).withColumn("duration", F.lit(1300.0)), ["recording"], 60.0)


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    spans = activity(spark, d).groupBy("recording").agg(F.max("time").alias("duration"))
    return G.backshift(G.fixed_chunks(spans, ["recording"]).drop("chunk"), ["recording"])


def to_absolute(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d).withColumn("chunk_start", F.floor(F.col("start") / 10) * 10.0).withColumn("chunk_end", F.col("chunk_start") + 7.5)
    return G.to_absolute(rows.withColumn("end", F.col("end") - F.col("chunk_start")).withColumn("start", F.col("start") - F.col("chunk_start"))).select("recording", "seq", "start", "end")


def _heard(spark: SparkSession, d: str) -> DataFrame:
    """Recogniser output: whole turns that repeat and overlap one another, on two channels."""
    words = T.tokens(F.col("text"))
    base = segments(spark, d).select("recording", "seq", "speaker", "start", "end", F.array_join(words, " ").alias("text")).where("text <> ''")
    repeated = base.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 100).withColumn("start", F.col("start") + 0.4)
    part = base.where("seq % 3 = 1").withColumn("seq", F.col("seq") + 200).withColumn("start", F.col("start") + 0.2).withColumn("text", F.array_join(F.slice(F.split("text", " "), 2, 4), " ")).where("text <> ''")
    follow = base.where("seq % 2 = 1").withColumn("seq", F.col("seq") + 300).withColumn("start", F.col("end") - 0.1).withColumn("end", F.col("end") + 0.8).withColumn("text", F.lower(F.concat_ws(" ", F.element_at(F.split("text", " "), -1), F.lit("and then"))))
    return base.unionByName(repeated).unionByName(part).unionByName(follow)


def dedup_segments(spark: SparkSession, d: str) -> DataFrame:
    return folds.deduplicate(_heard(spark, d), ["recording"])


def merge_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return folds.merge_overlapping(_heard(spark, d), ["recording"])


def merge_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return folds.merge_adjacent(_heard(spark, d), ["recording"])


def strip_boundaries(spark: SparkSession, d: str) -> DataFrame:
    spelled = _heard(spark, d).withColumn("text", F.when(F.col("seq") % 2 == 0, F.concat("text", F.lit(" A-B-C"))).otherwise(F.concat(F.lit("ABC, "), F.col("text"))))
    return folds.strip_boundaries(spelled, ["recording"])


def boundary_trim(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d)
    words = T.tokens(F.col("text"))
    led = F.concat_ws(" ", F.lag(F.array_join(F.slice(words, F.greatest(F.size(words) - 2, F.lit(1)), F.lit(9)), " ")).over(_by_seq()), F.col("text"))
    return folds.trim_boundaries(rows.withColumn("text", led), ["recording"])


def _by_seq():
    from pyspark.sql import Window

    return Window.partitionBy("recording").orderBy("seq")


def postprocess(spark: SparkSession, d: str) -> DataFrame:
    return folds.postprocess(_heard(spark, d), ["recording"])


def cross_channel_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d)
    other = rows.withColumn("speaker", F.when(F.col("speaker") == "interviewer", "interviewee").otherwise("interviewer")).withColumn("seq", F.col("seq") + 100).withColumn("start", F.col("start") + F.when(F.col("seq") % 2 == 0, 0.5).otherwise(1.5))
    return folds.cross_channel(rows.unionByName(other)).select("recording", "seq", "speaker", "start")


def region_times(spark: SparkSession, d: str) -> DataFrame:
    rows = segments(spark, d)
    return vad.region_times(rows.select("recording", "seq", F.when(F.col("seq") % 3 != 0, F.col("start")).alias("start"), F.when(F.col("seq") % 2 == 0, F.col("end")).alias("end"), F.lit(1.25).alias("duration"), F.lit(20.0).alias("total")), ["recording"])


QUERIES = {
    f.__name__: f
    for f in (
        window_filter, clip_by_ratio, window_text, recording_filter, full_reference, eval_reference, full_transcript, speaker_summary, exact_dedup, formal_segments, default_duration, part_offsets, make_segments, enriched,
        vad_windows, vad_parts, packed_part_map, packed_to_original, packed_to_absolute, vad_chunks, fixed_chunks, to_absolute, dedup_segments, merge_overlaps, merge_adjacent, strip_boundaries, boundary_trim, postprocess, cross_channel_dedup, region_times,
    )
}

_asr = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '\[.*?\]', '', 'g'), '\s+', ' ', 'g'))"
_TRUTH = f"""{SEGMENTS},
truth AS (SELECT recording, seq, format('seg_{{:05d}}', seq + 1) AS id, speaker = 'system' AS joint, speaker, start, "end", text,
  substring(text, 1, CAST(floor(length(text) / 2) AS INTEGER)) AS ee, substring(text, CAST(floor(length(text) / 2) AS INTEGER) + 1) AS er FROM segments)"""
_D = lambda x: f"CAST({x} AS DOUBLE)"
_clip = f"""CASE WHEN text = '' THEN '' WHEN least("end", {HI}) <= greatest(start, {LO}) THEN '' WHEN r >= 0.98 THEN text WHEN r <= 0.02 OR len(ws) = 0 THEN ''
  ELSE array_to_string(ws[a + 1 : greatest(a + 1, least(b, len(ws)))], ' ') END"""
_GAPS = f"""{SEGMENTS}, moved AS (SELECT recording, seq, speaker, start + length(text) % 7 AS start FROM segments),
gaps AS (SELECT recording, lead(start) OVER (PARTITION BY recording ORDER BY start, seq) - start AS gap FROM moved),
dur AS (SELECT recording, CASE WHEN median(gap) FILTER (gap > 0) IS NULL THEN CAST(3.0 AS DOUBLE) ELSE least(CAST(10.0 AS DOUBLE), greatest(CAST(0.5 AS DOUBLE), median(gap) FILTER (gap > 0))) END AS duration FROM gaps GROUP BY recording)"""

ORACLE_SQL = {
    "window_filter": f"""WITH {SEGMENTS}, s AS (SELECT recording, seq, CASE WHEN seq <> 5 THEN start END AS a, CASE WHEN seq <> 2 THEN "end" END AS b FROM segments)
SELECT recording, seq FROM s WHERE a IS NULL OR (b IS NULL AND a >= {LO} AND a < {HI}) OR (b > {LO} AND a < {HI})""",
    "clip_by_ratio": rf"""WITH {SEGMENTS}, s AS (SELECT *, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws,
  (least("end", {_D(HI)}) - greatest(start, {_D(LO)})) / ("end" - start) AS r, greatest({_D(0.0)}, greatest(start, {_D(LO)}) - start) / ("end" - start) AS l, greatest({_D(0.0)}, "end" - least("end", {_D(HI)})) / ("end" - start) AS g FROM segments),
t AS (SELECT *, greatest(0, least(CAST(round_even(len(ws) * l, 0) AS INTEGER), len(ws) - 1)) AS a, CAST(round_even(len(ws) * (1.0 - g), 0) AS INTEGER) AS b FROM s)
SELECT recording, seq, {_clip} AS clipped FROM t""",
    "window_text": rf"""WITH {SEGMENTS}, s AS (SELECT *, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws, (least("end", {_D(HI)}) - start) / ("end" - start) AS r, greatest({_D(0.0)}, "end" - {_D(HI)}) / ("end" - start) AS g FROM segments WHERE trim(text) <> '' AND start < {HI}),
t AS (SELECT recording, seq, CASE WHEN r >= 0.98 OR "end" <= {HI} + 0.6 THEN trim(text) WHEN r <= 0.02 THEN '' ELSE array_to_string(ws[1 : greatest(1, least(CAST(round_even(len(ws) * (1.0 - g), 0) AS INTEGER), len(ws)))], ' ') END AS text FROM s)
SELECT recording, string_agg(text, ' ' ORDER BY seq) AS text FROM t WHERE text <> '' GROUP BY recording""",
    "recording_filter": f"""WITH {SEGMENTS}, s AS (SELECT recording, seq, id, CAST(recording AS INTEGER) // 4 AS file, CAST(recording AS INTEGER) // 2 * 2 AS wanted FROM segments),
m AS (SELECT *, file % 3 <> 0 AND starts_with(id, 'seg_' || wanted || '_') AS named FROM s), a AS (SELECT *, bool_or(named) OVER (PARTITION BY file) AS anyone FROM m)
SELECT CAST(file AS BIGINT) AS file, recording, seq, NOT anyone AS fallback_used FROM a WHERE named OR NOT anyone""",
    "full_reference": f"""WITH {SEGMENTS}, s AS (SELECT recording, seq, text, CASE WHEN seq = 1 AND CAST(recording AS INTEGER) % 2 = 0 THEN 'full_' || recording || '_transcript' WHEN seq = 0 THEN 'full_other_transcript' ELSE id END AS id FROM segments)
SELECT recording, trim(text) AS text, id FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY id <> 'full_' || recording || '_transcript', seq) AS k FROM s WHERE id LIKE 'full_%_transcript') WHERE k = 1""",
    "eval_reference": rf"""WITH {_TRUTH},
c AS (SELECT *, {_asr('er')} AS er2, {_asr('ee')} AS ee2 FROM truth WHERE speaker IN ('interviewer', 'interviewee', 'system')),
t AS (SELECT recording, seq, replace(id, 'seg_', 'seg_' || recording || '_') AS id, CASE WHEN NOT joint THEN speaker ELSE concat_ws('|', CASE WHEN er2 <> '' THEN 'interviewer' END, CASE WHEN ee2 <> '' THEN 'interviewee' END) END AS speakers, start, "end",
  CASE WHEN joint THEN concat_ws(' ', nullif(er2, ''), nullif(ee2, '')) ELSE {_asr('text')} END AS text, joint AND er2 <> '' AND ee2 <> '' AS is_overlap, CASE WHEN joint AND er2 <> '' AND ee2 <> '' THEN ee2 END AS said_by_interviewee FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY recording, start, "end", speakers, {norm_sql('text')} ORDER BY seq) AS k FROM t WHERE text <> '')
SELECT * EXCLUDE (k) FROM k WHERE k = 1""",
    "full_transcript": rf"""WITH {SEGMENTS} SELECT recording, 'full_' || recording || '_transcript' AS id, min(start) AS start, max("end") AS "end", string_agg(nullif({_asr('text')}, ''), ' ' ORDER BY seq) AS text FROM segments GROUP BY recording""",
    "speaker_summary": rf"""WITH {_TRUTH}, span AS (SELECT recording, min(start) AS start, max("end") AS "end" FROM truth GROUP BY recording),
said AS (SELECT recording, seq, speaker AS role, text FROM truth WHERE speaker IN ('interviewer', 'interviewee') UNION ALL SELECT recording, seq, 'interviewer', er FROM truth WHERE joint UNION ALL SELECT recording, seq, 'interviewee', ee FROM truth WHERE joint)
SELECT recording, role, 'full_' || recording || '_' || role AS id, any_value(start) AS start, any_value("end") AS "end", string_agg({_asr('text')}, ' ' ORDER BY seq) AS text FROM said JOIN span USING (recording) WHERE {_asr('text')} <> '' GROUP BY recording, role""",
    "exact_dedup": f"""WITH {SEGMENTS}, u AS (SELECT recording, seq, speaker, start, "end", text FROM segments UNION ALL SELECT recording, seq + 100, speaker, start, "end", '... ' || text FROM segments)
SELECT recording, seq, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY recording, start, "end", speaker, {norm_sql('text')} ORDER BY seq) AS k FROM u) WHERE k = 1""",
    "formal_segments": f"""WITH {_GAPS}, n AS (SELECT *, row_number() OVER w AS n, lead(start) OVER w AS nxt FROM moved WINDOW w AS (PARTITION BY recording ORDER BY start, seq))
SELECT recording, format('seg_{{}}_{{:05d}}', recording, n) AS id, CAST(n AS INTEGER) AS seq, round(start, 3) AS start, round(CASE WHEN nxt IS NULL THEN start + duration ELSE greatest(start + 0.001, nxt) END, 3) AS "end", speaker FROM n JOIN dur USING (recording)""",
    "default_duration": f"WITH {_GAPS} SELECT recording, duration FROM dur",
    "part_offsets": f"""WITH {SEGMENTS}, l AS (SELECT recording, CAST(seq // 2 AS BIGINT) AS part, greatest(0.0, max(start)) AS latest FROM segments GROUP BY ALL)
SELECT recording, part, CAST(coalesce(sum(latest) OVER (PARTITION BY recording ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS "offset" FROM l""",
    "make_segments": rf"""WITH {SEGMENTS}, e AS (SELECT recording, seq // 2 AS piece, seq, speaker, {_asr('text')} AS t FROM segments),
b AS (SELECT recording, piece, speaker, min(seq) AS s, string_agg(t, ' ' ORDER BY seq) AS t FROM e WHERE t <> '' GROUP BY ALL),
o AS (SELECT *, CASE speaker WHEN 'interviewer' THEN 0 WHEN 'interviewee' THEN 1 ELSE 99 END AS rk FROM b),
g AS (SELECT recording, piece, string_agg(speaker, '|' ORDER BY rk, s) AS speakers, string_agg(t, ' ' ORDER BY rk, s) AS text, count(*) > 1 AS is_overlap FROM o GROUP BY ALL),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY recording ORDER BY piece) AS INTEGER) AS seq FROM g)
SELECT recording, seq, format('seg_{{:05d}}', seq) AS id, speakers, piece * {_D(8.0)} AS start, piece * {_D(8.0)} + {_D(8.0)} AS "end", text, is_overlap FROM n""",
    "enriched": f"""WITH {SEGMENTS} SELECT recording, format('asr_{{:05d}}', row_number() OVER (PARTITION BY recording ORDER BY start, "end", seq)) AS id, speaker, speaker AS first, round(start, 3) AS start, round("end", 3) AS "end", false AS is_overlap FROM segments""",
    "vad_windows": f"WITH {_WINDOWS} SELECT * FROM windows",
    "vad_parts": f"WITH {_PARTS} SELECT * FROM parts",
    "packed_part_map": f"WITH {_PARTS} SELECT * FROM pm",
    "packed_to_original": f"""WITH {_PARTS}, o AS (SELECT recording, CAST("time" AS BIGINT) AS id, "time" / {_D(2.0)} - {_D(3.0)} AS "offset", greatest({_D(0.0)}, "time" / {_D(2.0)} - {_D(3.0)}) AS t FROM activity),
h AS (SELECT o.*, (SELECT min({{'i': idx, 'v': least(original_end, greatest(original_start, original_start + t - packed_start))}}) FROM pm WHERE pm.recording = o.recording AND t BETWEEN packed_start AND packed_end) AS hit,
  (SELECT arg_max(original_end, idx) FROM pm WHERE pm.recording = o.recording AND packed_end < t) AS past, (SELECT arg_min(original_start, idx) FROM pm WHERE pm.recording = o.recording) AS head FROM o)
SELECT recording, id, "offset", coalesce(hit.v, past, head, "offset") AS original FROM h""",
    "packed_to_absolute": f"""WITH {_PARTS}, q AS (SELECT recording, CAST("time" AS BIGINT) AS id, "time" % 50 / {_D(2.0)} - {_D(3.0)} AS a, "time" % 50 / {_D(2.0)} - {_D(3.0)} + "time" % 7 - {_D(1.0)} AS b, floor("time" / 60) * {_D(20.0)} AS c FROM activity),
e AS (SELECT recording, id, c + greatest({_D(0)}, least(a, c + {_D(15.0)} - c)) AS a, c + greatest({_D(0)}, least(b, c + {_D(15.0)} - c)) AS b FROM q),
o AS (SELECT recording, id, edge, t FROM (SELECT recording, id, unnest([0, 1]) AS edge, unnest([a, b]) AS t FROM e WHERE b > a)),
h AS (SELECT o.*, (SELECT min({{'i': idx, 'v': least(original_end, greatest(original_start, original_start + t - packed_start))}}) FROM pm WHERE pm.recording = o.recording AND t BETWEEN packed_start AND packed_end) AS hit,
  (SELECT arg_max(original_end, idx) FROM pm WHERE pm.recording = o.recording AND packed_end < t) AS past, (SELECT arg_min(original_start, idx) FROM pm WHERE pm.recording = o.recording) AS head FROM o)
SELECT recording, id, {_D(100.0)} + max(coalesce(hit.v, past, head, t)) FILTER (edge = 0) AS start, {_D(100.0)} + max(coalesce(hit.v, past, head, t)) FILTER (edge = 1) AS "end" FROM h GROUP BY recording, id""",
    "fixed_chunks": f"""WITH {ACTIVITY}, s AS (SELECT recording, max("time") AS duration FROM activity GROUP BY recording),
c AS (SELECT recording, duration, unnest(range(0, greatest(CAST(ceil(duration / {_D(360.0)}) AS INTEGER), 1))) AS k FROM s WHERE duration > 0)
SELECT recording, k * {_D(360.0)} AS start, least(duration, (k + 1) * {_D(360.0)}) AS "end", CAST(k + 1 AS INTEGER) AS chunk, CASE WHEN k > 0 THEN greatest({_D(0.0)}, k * {_D(360.0)} - {_D(1.0)}) ELSE k * {_D(360.0)} END AS decode_start FROM c""",
    "to_absolute": f"""WITH {SEGMENTS}, c AS (SELECT recording, seq, floor(start / 10) * {_D(10.0)} AS cs, start - floor(start / 10) * {_D(10.0)} AS a, "end" - floor(start / 10) * {_D(10.0)} AS b FROM segments),
p AS (SELECT recording, seq, least(cs + {_D(7.5)}, greatest(cs, cs + a)) AS start, least(cs + {_D(7.5)}, greatest(cs, cs + b)) AS "end" FROM c) SELECT * FROM p WHERE "end" > start""",
}

# Folds as recursions over places, an independent reading of the same rules.
_keyed = lambda x: rf"list_transform({x}, lambda w: regexp_replace(lower(w), '[^\p{{L}}\p{{N}}_]', '', 'g'))"
ORACLE_SQL |= {
    "cross_channel_dedup": f"""WITH RECURSIVE {SEGMENTS},
u AS (SELECT recording, seq, speaker, start, "end", text FROM segments UNION ALL
  SELECT recording, seq + 100, CASE speaker WHEN 'interviewer' THEN 'interviewee' ELSE 'interviewer' END, start + CASE WHEN seq % 2 = 0 THEN {_D(0.5)} ELSE {_D(1.5)} END, "end", text FROM segments),
n AS (SELECT recording, seq, speaker, start, "end", {norm_sql('text')} AS norm FROM u),
o AS (SELECT *, row_number() OVER (PARTITION BY recording, norm ORDER BY start, "end", seq) AS k FROM n WHERE norm <> ''),
f(recording, norm, k, kept, dup) AS (
  SELECT DISTINCT recording, norm, CAST(0 AS BIGINT), CAST([] AS STRUCT(s DOUBLE, e DOUBLE, p VARCHAR)[]), true FROM o
  UNION ALL
  SELECT recording, norm, k, CASE WHEN dup THEN kept ELSE list_append(kept, {{'s': start, 'e': "end", 'p': speaker}}) END, dup FROM (
    SELECT o.recording, o.norm, o.k, o.start, o."end", o.speaker, f.kept, len(list_filter(f.kept, lambda x: o.start - x.s <= 1.0 AND o."end" >= x.s AND o.start <= x.e AND o.speaker <> x.p)) > 0 AS dup
    FROM f JOIN o ON o.recording = f.recording AND o.norm = f.norm AND o.k = f.k + 1))
SELECT o.recording, o.seq, o.speaker, o.start FROM o JOIN f USING (recording, norm, k) WHERE NOT f.dup""",
    "vad_chunks": f"""WITH RECURSIVE {_WINDOWS},
w AS (SELECT recording, greatest({_D(0.0)}, start) AS a, least({_D(1300.0)}, "end") AS b FROM windows),
o AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY a, b) AS k FROM w WHERE b > a),
fold(recording, k, cs, ce, done) AS (
  SELECT DISTINCT recording, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST([] AS DOUBLE[][]) FROM o
  UNION ALL
  SELECT recording, k, ns + n * {_D(60.0)}, ne, list_concat(closed, list_transform(range(0, n), lambda i: [ns + i * {_D(60.0)}, ns + (i + 1) * {_D(60.0)}])) FROM (
    SELECT *, CASE WHEN ne - ns > 60.0 THEN CAST(ceil((ne - ns) / {_D(60.0)}) AS BIGINT) - 1 ELSE 0 END AS n FROM (
      SELECT o.recording, o.k, CASE WHEN cs IS NULL OR b - cs > 60.0 THEN a ELSE cs END AS ns, CASE WHEN cs IS NULL OR b - cs > 60.0 THEN b ELSE greatest(ce, b) END AS ne,
        CASE WHEN b - cs > 60.0 THEN [[cs, ce]] ELSE CAST([] AS DOUBLE[][]) END AS closed FROM fold JOIN o ON o.recording = fold.recording AND o.k = fold.k + 1))),
chunks AS (SELECT recording, unnest(done) AS p FROM fold UNION ALL SELECT recording, [cs, ce] FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY k DESC) AS z FROM fold) WHERE z = 1 AND ce > cs)
SELECT recording, p[1] AS start, p[2] AS "end" FROM chunks""",
    "boundary_trim": rf"""WITH RECURSIVE {SEGMENTS},
x AS (SELECT *, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM segments),
l AS (SELECT *, concat_ws(' ', lag(array_to_string(ws[greatest(len(ws) - 2, 1) : greatest(len(ws) - 2, 1) + 8], ' ')) OVER (PARTITION BY recording ORDER BY seq), text) AS led FROM x),
o AS (SELECT *, list_filter(string_split(trim(regexp_replace(led, '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS lw, row_number() OVER (PARTITION BY recording ORDER BY seq) AS k FROM l WHERE led <> ''),
f(recording, k, before, out) AS (
  SELECT DISTINCT recording, CAST(0 AS BIGINT), '', '' FROM o
  UNION ALL
  SELECT recording, k, CASE WHEN t = '' THEN before ELSE t END, t FROM (
    SELECT recording, k, before, CASE WHEN n > 0 THEN array_to_string(lw[n + 1 :], ' ') ELSE led END AS t FROM (
      SELECT *, coalesce(list_max(list_filter(range(1, {V.BOUNDARY_WORDS} + 1), lambda j: j <= len(pk) AND j <= len(ck) AND pk[len(pk) - j + 1 : len(pk)] = ck[1 : j])), 0) AS n FROM (
        SELECT o.recording, o.k, f.before, o.led, o.lw, {_keyed('o.lw')} AS ck, {_keyed(r"list_filter(string_split(trim(regexp_replace(f.before, '\s+', ' ', 'g')), ' '), lambda w: w <> '')")} AS pk FROM f JOIN o ON o.recording = f.recording AND o.k = f.k + 1))))
SELECT o.recording, o.seq, o.id, o.speaker, o.start, o."end", f.out AS text FROM o JOIN f USING (recording, k) WHERE f.out <> ''""",
}
ORACLE_SQL |= fold_sql.ORACLE_SQL

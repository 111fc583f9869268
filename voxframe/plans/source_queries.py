"""Queries of the sources: files of every format, made of the tables' rows and read back.

A file is a conversation (or a thousand documents), so files stay small while the tables grow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import text as T
from voxframe.plans.inputs import SEGMENTS, norm_sql, segments, table, tokens_sql
from voxframe.sources import hypotheses, transcripts


def _lines(line: str, order: str) -> Column:
    return F.expr(f"listagg({line}, '\n') WITHIN GROUP (ORDER BY {order})")


def formal_lines(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("speaker") == "interviewer", "R").when(F.col("speaker") == "interviewee", "M").otherwise("F")
    line = F.format_string("%s_%s_%d_(%.2f)\t%s", "recording", code, F.floor(F.col("seq") / 2) + 1, "start", "text")
    rows = segments(spark, d).where("text is not null").withColumn("line", line)
    files = rows.groupBy(F.col("recording").alias("name")).agg(_lines("line", "seq").alias("text"))
    return transcripts.formal_rows(files).select("recording", "recording_key", "speaker_code", "speaker", "part", "start", "seq", "text")


def annotated_files(spark: SparkSession, d: str) -> DataFrame:
    """XML with a mark after the first half of each turn, so that a turn has two pieces."""
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    middle = F.format_string('<Sync time="%.3f"/>', (F.col("start") + F.col("end")) / 2)
    turn = F.format_string('<Turn speaker="%s" startTime="%.3f" endTime="%.3f"><Sync time="%.3f"/>%s%s and on</Turn>', "speaker", "start", "end", "start", safe, middle)
    rows = segments(spark, d).where("text is not null").withColumn("line", turn)
    files = rows.groupBy(F.col("recording").alias("name")).agg(_lines("line", "seq").alias("turns"))
    names = '<Speakers><Speaker id="interviewer" name="interviewer"/><Speaker id="interviewee" name="interviewee"/></Speakers>'
    files = files.select("name", F.concat(F.lit(f"<Trans>{names}<Episode>"), "turns", F.lit("</Episode></Trans>")).alias("text"))
    out = transcripts.annotated_segments(files)
    return out.select("recording", "seq", "id", F.array_join("speakers", "|").alias("speakers"), "start", "end", "text", "is_overlap")


def json_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Segments as a list, under "segments", and by recording."""
    one = F.struct("seq", F.struct("id", "start", "end", "text").alias("s"))
    files = segments(spark, d).groupBy(F.col("recording").alias("name")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("r"))
    shape = F.col("name").cast("int") % 3
    keyed = F.to_json(F.create_map("name", "r"))
    text = F.when(shape == 0, F.to_json("r")).when(shape == 1, F.to_json(F.struct(F.col("r").alias("segments")))).otherwise(keyed)
    out = hypotheses.flatten_segments(files.select("name", text.alias("text")), ["name"])
    return out.select("name", "recording", "seq", "id", "start", "end", "text")


def channel_files(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts of two channels, or segments of these, as recognisers of split channels write them."""
    rows = segments(spark, d).where("text is not null").withColumn("speaker", F.when(F.col("speaker") == "interviewer", "Speaker_L").otherwise("Speaker_R"))
    whole = lambda s: F.expr(f"listagg(text, ' ') WITHIN GROUP (ORDER BY seq) FILTER (WHERE speaker = '{s}')")
    one = F.struct("seq", F.struct("speaker", "text", "start").alias("s"))
    files = rows.groupBy(F.col("recording").alias("name")).agg(
        whole("Speaker_L").alias("Speaker_L_full_transcription"), whole("Speaker_R").alias("speaker_R_full_transcription"),
        F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("segments"),
    )
    even = F.col("name").cast("int") % 2 == 0
    text = F.when(even, F.to_json(F.struct("Speaker_L_full_transcription", "speaker_R_full_transcription"))).otherwise(F.to_json(F.struct("segments")))
    return hypotheses.speaker_transcriptions(files.select("name", text.alias("text")), ["name"])


def word_map(spark: SparkSession, d: str) -> DataFrame:
    """Map lines with tabs or blanks between the words, some of them remarks; of a repeated variant the last one counts."""
    rows = table(spark, d, "documents").where("source is not null and lang is not null")
    group = F.floor(F.col("doc_id") / 1000)
    variant = F.format_string("%s_%d_%d", F.upper("lang"), group, F.col("doc_id") % 50)
    gap = F.when(F.col("doc_id") % 2 == 0, "\t").otherwise(" ")
    line = F.concat(F.when(F.col("doc_id") % 7 == 0, "# ").otherwise(""), F.replace("source", F.lit(" "), F.lit("_")), gap, variant)
    files = rows.select("doc_id", group.alias("name"), line.alias("line")).groupBy("name").agg(_lines("line", "doc_id").alias("text"))
    return transcripts.variant_map(files)


def arpa_words(spark: SparkSession, d: str) -> DataFrame:
    """A language model a recording, of the words said in it; pairs of words and marks are not among its unigrams."""
    rows = segments(spark, d).select(F.col("recording").alias("name"), "seq", F.explode(T.tokens(T.normalize_for_dedup(F.col("text")))).alias("w"))
    grams = rows.withColumn("line", F.concat(F.lit("-1.5\t"), "w", F.lit("\t-0.25"))).groupBy("name").agg(_lines("line", "seq").alias("one"), F.min("w").alias("least"))
    head = "\\data\\\nngram 1=3\n\n\\1-grams:\n-9 <unk>\n-9 <s> -0.1\n-9 </s>\n"
    files = grams.select("name", F.concat(F.lit(head), "one", F.lit("\n\n\\2-grams:\n-2 "), "least", F.lit(" zzz\n\\end\\\n")).alias("text"))
    return transcripts.arpa_unigrams(files)


QUERIES = {f.__name__: f for f in (formal_lines, annotated_files, json_shapes, channel_files, word_map, arpa_words)}

_asr = lambda x: rf"trim(regexp_replace(regexp_replace({x}, '\[.*?\]', '', 'g'), '\s+', ' ', 'g'))"
ORACLE_SQL = {
    "formal_lines": f"""WITH {SEGMENTS}, l AS (SELECT recording, speaker, CASE speaker WHEN 'interviewer' THEN 'R' WHEN 'interviewee' THEN 'M' ELSE 'F' END AS speaker_code, seq // 2 + 1 AS part, start,
  CAST(row_number() OVER (PARTITION BY recording ORDER BY seq) AS INTEGER) AS seq, {_asr('text')} AS text FROM segments WHERE text IS NOT NULL)
SELECT recording, format('{{}}_{{:03d}}', recording, part) AS recording_key, speaker_code, CASE speaker_code WHEN 'R' THEN 'interviewer' ELSE 'interviewee' END AS speaker, CAST(part AS INTEGER) AS part, start, seq, text FROM l WHERE text <> ''""",
    "annotated_files": f"""WITH {SEGMENTS}, p AS (SELECT recording, seq * 2 AS piece, speaker, start, round((start + "end") / 2, 3) AS "end", {_asr('text')} AS text FROM segments WHERE text IS NOT NULL
  UNION ALL SELECT recording, seq * 2 + 1, speaker, round((start + "end") / 2, 3), round("end", 3), 'and on' FROM segments WHERE text IS NOT NULL)
SELECT recording, CAST(n AS INTEGER) AS seq, format('seg_{{:05d}}', n) AS id, speaker AS speakers, start, "end", text, false AS is_overlap FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY piece) AS n FROM p WHERE text <> '')""",
    "json_shapes": f"""WITH {SEGMENTS} SELECT recording AS name, CASE WHEN CAST(recording AS INTEGER) % 3 = 2 THEN recording END AS recording,
  CAST(row_number() OVER (PARTITION BY segments.recording ORDER BY seq) - 1 AS INTEGER) AS seq, id, start, "end", text FROM segments""",
    "channel_files": f"""WITH {SEGMENTS}, s AS (SELECT recording, seq, CASE speaker WHEN 'interviewer' THEN 'speaker_l' ELSE 'speaker_r' END AS channel, text FROM segments WHERE text IS NOT NULL),
w AS (SELECT recording AS name, channel, CASE WHEN CAST(recording AS INTEGER) % 2 = 0 THEN trim(string_agg(text, ' ' ORDER BY seq)) ELSE string_agg(nullif(trim(text), ''), ' ' ORDER BY seq) END AS text FROM s GROUP BY recording, channel)
SELECT name, channel, coalesce(text, '') AS text FROM w WHERE text IS NOT NULL""",
    "word_map": """WITH m AS (SELECT doc_id, lower(format('{}_{}_{}', lang, doc_id // 1000, doc_id % 50)) AS variant, lower(replace(source, ' ', '_')) AS canonical FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND doc_id % 7 <> 0)
SELECT variant, arg_max(canonical, doc_id) AS canonical FROM m GROUP BY variant""",
    "arpa_words": f"WITH {SEGMENTS} SELECT DISTINCT recording AS name, unnest({tokens_sql(norm_sql('text'))}) AS word FROM segments",
}

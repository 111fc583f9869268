"""Recogniser output and ground truth in JSON, whatever shape they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions import text as T

SEGMENT = "struct<id: string, speaker: string, speakers: array<string>, start: double, end: double, text: string, is_overlap: boolean, text_by_speaker: map<string, string>>"
METADATA = (
    "struct<mode: string, start_seconds: double, end_seconds: double, limit_seconds: double, has_custom_range: boolean, model: string, backend: string, asr_backend: string, "
    "chunk_seconds: double, chunk_overlap_seconds: double, chunk_backshift_seconds: double, boundary_max_overlap_words: int, dedup_time_tolerance: double, adjacent_merge_gap_seconds: double, "
    "vad_min_dur: double, vad_max_dur: double, vad_max_silence: double, vad_energy_threshold: double, lm_enabled: boolean, lm_path: string, runtime_seconds: double, run_started_utc: string, run_finished_utc: string>"
)
_KEY = r"^\d+(_\d+)?$"


def _kind(json: Column) -> Column:
    return F.substring(F.ltrim(json), 1, 1)


def _like(json: Column) -> Column:
    """Whether an object looks like a segment: a text and one more of its fields."""
    keys = F.json_object_keys(json)
    return F.array_contains(keys, "text") & F.arrays_overlap(keys, F.array(*map(F.lit, ("id", "start", "end", "speakers", "is_overlap"))))


def _objects(json: Column) -> Column:
    """An array's objects, as JSON texts."""
    return F.filter(F.from_json(json, "array<string>"), lambda x: F.coalesce(_kind(x) == "{", F.lit(False)))


def flatten_segments(files: DataFrame, keys: list[str]) -> DataFrame:
    """files (keys, text) -> keys, recording (null for plain lists), seq and the segment's fields.

    Shapes, in this order: a list; an object with a list under segments or data; an object of recordings, by number, whose
    values are lists, segments, or objects of such. What isn't an object is left out.
    """
    top = F.from_json("text", "map<string, string>")
    one = lambda parts, k, r: F.transform(parts, lambda x: F.struct(k.alias("major"), r.alias("recording"), x.alias("json")))
    none = F.lit(None).cast("string")
    listed = lambda c: one(_objects(c), F.array(F.lit(0)), none)

    def of_value(e: Column) -> Column:
        v, key = e["value"], e["key"]
        order = F.array(F.split(key, "_")[0].cast("int"), F.coalesce(F.try_element_at(F.split(key, "_"), F.lit(2)).cast("int"), F.lit(-1)))
        nested = F.flatten(F.transform(F.map_values(F.from_json(v, "map<string, string>")), lambda x: F.when(_kind(x) == "[", _objects(x)).when((_kind(x) == "{") & _like(x), F.array(x)).otherwise(F.array().cast("array<string>"))))
        parts = F.when(_kind(v) == "[", _objects(v)).when((_kind(v) == "{") & _like(v), F.array(v)).when(_kind(v) == "{", nested).otherwise(F.array().cast("array<string>"))
        return one(parts, order, key)

    recordings = F.flatten(F.array_sort(F.transform(F.filter(F.map_entries("_top"), lambda e: e["key"].rlike(_KEY)), of_value)))
    segments, data = F.try_element_at("_top", F.lit("segments")), F.try_element_at("_top", F.lit("data"))
    shaped = F.when(_kind(F.col("text")) == "[", listed(F.col("text"))).when(_kind(segments) == "[", listed(segments)).when(_kind(data) == "[", listed(data)).otherwise(recordings)
    rows = files.withColumn("_top", F.when(_kind(F.col("text")) == "{", top)).select(*keys, F.posexplode(shaped).alias("seq", "s"))
    return rows.select(*keys, F.col("s.recording").alias("recording"), "seq", F.from_json("s.json", SEGMENT).alias("x")).select(*keys, "recording", "seq", "x.*")


def hypotheses(files: DataFrame) -> DataFrame:
    """files (name, text) -> name, recording, is_full, metadata, full_transcription, segments."""
    fields = F.from_json("text", f"struct<metadata: {METADATA}, full_transcription: string, segments: array<{SEGMENT}>>")
    rows = files.select("name", T.recording_id(F.col("name")).alias("recording"), T.is_full_hypothesis(F.col("name")).alias("is_full"), fields.alias("h"))
    meta = F.col("h.metadata")
    return rows.select("name", "recording", "is_full", meta.alias("metadata"), T.is_whisper(meta["backend"], meta["model"], meta["asr_backend"]).alias("is_whisper"), F.col("h.full_transcription").alias("full_transcription"), F.col("h.segments").alias("segments"))


def speaker_transcriptions(files: DataFrame, keys: list[str]) -> DataFrame:
    """files (keys, text) -> keys, channel, text: whole texts per channel, whatever case their keys have; where there are
    none, a channel's segments joined."""
    found = F.filter(F.map_entries(F.from_json("text", "map<string, string>")), lambda e: e["key"].rlike(r"(?i)^speaker_[lr]_full_transcription\z"))
    own = F.transform(found, lambda e: F.struct(F.regexp_extract(F.lower(e["key"]), "^(speaker_[lr])", 1).alias("channel"), T.clean_text(e["value"]).alias("text")))
    rows = files.select(*keys, "text", own.alias("_own"))
    direct = rows.where(F.size("_own") > 0).select(*keys, F.inline("_own"))
    segments = rows.where(F.coalesce(F.size("_own"), F.lit(0)) <= 0).select(*keys, F.posexplode(F.from_json("text", f"struct<segments: array<{SEGMENT}>>")["segments"]).alias("seq", "s"))
    said = segments.select(*keys, "seq", F.lower(T.clean_text(F.col("s.speaker"))).alias("channel"), T.clean_text(F.col("s.text")).alias("text")).where("channel <> '' AND text <> ''")
    return direct.unionByName(said.groupBy(*keys, "channel").agg(F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY seq)").alias("text")))


def role_texts(files: DataFrame) -> DataFrame:
    """Speaker ground truth (text: object of recordings, of roles) -> recording, role, text."""
    top = F.from_json("text", "map<string, map<string, struct<id: string, start: double, end: double, text: string>>>")
    rows = files.select(F.explode(top).alias("recording", "roles")).select("recording", F.explode("roles").alias("role", "s"))
    return rows.select("recording", "role", "s.start", "s.end", T.clean_text(F.col("s.text")).alias("text"))


def roles_of(recordings: DataFrame, texts: DataFrame) -> DataFrame:
    """recordings (recording) with both roles' texts: their own or, where a recording has none, those of the first
    recording that has both (fallback_used says so)."""
    both = texts.where(F.col("role").isin("interviewer", "interviewee"))
    whole = both.groupBy("recording").agg(F.count_distinct("role").alias("n")).where("n = 2").agg(F.min("recording").alias("_first"))
    known = texts.select("recording").distinct().withColumn("_own", F.lit(True))
    rows = recordings.join(known, "recording", "left").join(F.broadcast(whole), F.lit(True), "left")  # one row
    rows = rows.withColumn("_from", F.when(F.col("_own"), F.col("recording")).otherwise(F.col("_first")))
    return rows.join(both.withColumnRenamed("recording", "_from"), "_from").select("recording", "role", "text", F.col("_own").isNull().alias("fallback_used"))


def pretty_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as JSON texts, unescaped and indented, ready for write.text."""
    return rows.select(F.to_json(F.struct(*columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def hypothesis_json(segments: DataFrame, metadata: DataFrame, keys: list[str], spoken: DataFrame | None = None, extra: dict[str, str] | None = None) -> DataFrame:
    """One JSON text per recording of ``metadata``: metadata, segments in order, texts of ``spoken`` (extra: their names and
    columns; what isn't there is empty), full transcription."""
    fields = [c for c in segments.columns if c not in keys]
    grouped = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.struct(*fields).alias("s")))).alias("r"))
    kind = segments.select(F.array(F.struct(*fields)).alias("r")).schema["r"].dataType
    rows = metadata.join(grouped, keys, "left").withColumn("r", F.coalesce(F.transform("r", lambda x: x["s"]), F.array().cast(kind)))
    if spoken is not None:
        rows = rows.join(spoken, keys, "left")
    own = [F.coalesce(F.col(c), F.lit("")).alias(name) for name, c in (extra or {}).items()]
    rows = rows.select(*keys, F.struct("metadata", F.col("r").alias("segments"), *own, F.array_join("r.text", " ").alias("full_transcription")).alias("v"))
    return rows.select(*keys, F.to_json("v", {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))

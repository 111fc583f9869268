"""Whole jobs over files: evaluation of texts and of speakers, ground truth, audio.

Any number of files goes through one plan. Results are DataFrames of texts (JSON or reports), ready for ``write.text``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from voxframe.functions import fixed_values as V
from voxframe.functions import text as T
from voxframe.operators import evaluation as E
from voxframe.operators import folds, recognition, signal
from voxframe.operators import segments as G
from voxframe.plans import reports
from voxframe.plans.storage import kept
from voxframe.sources import audio, hypotheses, transcripts

# ---- text evaluation ---------------------------------------------------------------------------------------------------


def _hypothesis_texts(files: DataFrame) -> DataFrame:
    """name, recording, is_full, is_whisper, metadata, lo, hi, hyp: what a recogniser said inside the evaluated window."""
    meta = F.col("metadata")
    heads = hypotheses.hypotheses(files).withColumn("w", G.eval_window(F.col("is_full"), meta["start_seconds"], meta["end_seconds"], meta["limit_seconds"]))
    heads = heads.select("name", "recording", "is_full", "is_whisper", "metadata", "full_transcription", F.coalesce(F.size("segments"), F.lit(0)).alias("n_segments"), "w.lo", "w.hi")
    segments = hypotheses.flatten_segments(files, ["name"]).drop("recording").join(heads.select("name", "lo", "hi"), "name")
    said = G.window_text(segments, ["name"], F.col("lo"), F.col("hi")).withColumnRenamed("text", "_said")
    rows = heads.join(said, "name", "left")
    whole = (F.trim(F.coalesce("full_transcription", F.lit(""))) != "") & (F.col("n_segments") <= 0)
    return rows.withColumn("hyp", F.when(whole, F.col("full_transcription")).otherwise(F.coalesce("_said", F.lit("")))).drop("_said", "n_segments", "full_transcription")


def _reference_texts(sections: DataFrame, truth: DataFrame) -> DataFrame:
    """sections (name, recording, path, is_full, lo, hi) with ref and its source."""
    keys = ["name", "path"]
    # a recording's own segments by path and recording; whole files only where they don't name it
    known = truth.select("path", "recording").distinct().withColumn("_has", F.lit(True))
    wanted = sections.select(*keys, "recording", "is_full", "lo", "hi").join(known, ["path", "recording"], "left")
    own = truth.join(wanted.where("_has").drop("_has"), ["path", "recording"])
    others = truth.drop("recording").join(wanted.where("_has is null").drop("_has"), "path")
    rows = own.unionByName(others)
    exact = F.col("id") == F.concat(F.lit("full_"), F.col("recording"), F.lit("_transcript"))
    full = rows.where(F.col("is_full") & G.is_full_transcript(F.col("id"))).groupBy(*keys).agg(F.min_by(F.struct(T.clean_text(F.col("text")).alias("text"), "id"), F.struct(~exact, F.col("seq"))).alias("_full"))
    parts = rows.where(F.col("is_full") | ~G.is_full_transcript(F.col("id")))
    windowed = G.window_text(G.of_recording(parts, "recording", keys), keys, F.col("lo"), F.col("hi")).withColumnRenamed("text", "_windowed")
    out = sections.join(full, keys, "left").join(windowed, keys, "left")
    found = F.coalesce(F.col("_full.text"), F.lit("")) != ""
    source = F.when(found, F.concat(F.lit("full_transcript ("), F.col("_full.id"), F.lit(")"))).when(F.col("is_full"), "full_transcript (fallback)").otherwise("segments")
    return out.withColumn("ref", F.when(found, F.col("_full.text")).otherwise(F.coalesce("_windowed", F.lit("")))).withColumn("source", source).drop("_full", "_windowed")


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _map_lines(name: str, label: str, enabled: Column, entries: int) -> Column:
    """A dictionary's lines in a report."""
    impact = lambda c: F.col(f"{name}_{c}") * 100
    used = F.when(enabled, "hyp_substitutions").otherwise("none")
    first = F.format_string(f"{label}: enabled=%s | applied_to=%s | entries=%d | checked_sub_spans=%d | replaced_tokens=%d", F.initcap(enabled.cast("string")), used, F.lit(entries), F.coalesce(f"{name}_checked", F.lit(0)), F.coalesce(f"{name}_replaced", F.lit(0)))
    second = F.format_string(f"{label} impact (WER): before=%.2f %% | after=%.2f %% | delta=%+.2f p.b.", impact("before"), impact("after"), impact("after") - impact("before"))
    return F.when(enabled & F.col(f"{name}_before").isNotNull(), F.array(first, second)).otherwise(F.array(first))


def _optional(rows: DataFrame, enabled: str, mapping: DataFrame | None, keys: list[str], name: str) -> DataFrame:
    """A dictionary pass for the rows in which it is enabled; the others get its columns empty."""
    empty = {f"{name}_checked": "int", f"{name}_replaced": "int", f"{name}_before": "double", f"{name}_after": "double", f"{name}_used": "boolean"}
    plain = rows if mapping is None else rows.where(~F.col(enabled))
    for c, kind in empty.items():
        plain = plain.withColumn(c, F.lit(None).cast(kind))
    return plain if mapping is None else plain.unionByName(E.corrected(rows.where(enabled), mapping, keys, name))


def evaluate_texts(spark: SparkSession, hypothesis_paths: str | list[str], truth_paths: str | list[str], words: DataFrame | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """name, path, section, metrics and the report section of every hypothesis against each of its ground truths.

    Truth files are <recording>_gt_segments.json and all_formal_gt_segments.json. The word map applies to truths so named,
    the number map to Whisper's output; a section whose reference or hypothesis is blank is left out.
    """
    from voxframe.operators import alignment as A

    keys = ["name", "path"]
    said = kept(_hypothesis_texts(kept(transcripts.read_text(spark, hypothesis_paths))))
    truth_files = kept(transcripts.read_text(spark, truth_paths))
    sources = transcripts.ground_truth_sources(truth_files.select("name", "path"), said.select("recording").distinct())
    sections = said.join(sources, "recording")
    truth = kept(hypotheses.flatten_segments(truth_files, ["path"]))
    pairs = _reference_texts(sections, truth)
    pairs = pairs.withColumn("ref", T.tokens(T.normalize_text(F.col("ref")))).withColumn("hyp", T.tokens(T.normalize_text(F.col("hyp")))).where((F.size("ref") > 0) & (F.size("hyp") > 0))
    pairs = pairs.withColumn("use_words", F.col("path").rlike(r"_gt_segments\.json$")).withColumn("use_numbers", F.col("is_whisper"))
    rows = kept(A.with_alignment(kept(pairs)))
    rows = kept(_optional(rows, "use_numbers", numbers, keys, "numbers"))
    rows = kept(_optional(rows, "use_words", words, keys, "words"))
    offsets = E.offset_compensation(rows, keys)
    rows = rows.join(offsets, keys)
    counts = [0 if m is None else m.count() for m in (words, numbers)]
    comp = F.when(F.col("use"), F.array(F.concat(F.lit("WER (OFFSET-COMP): "), reports.percent(F.col("comp_wer"))))).otherwise(F.array().cast("array<string>"))
    offset = F.format_string("Offset compensation: use=%s | ref_trim=%d | hyp_trim=%d | improvement=%.2f p.b.", F.initcap(F.col("use").cast("string")), "ref_trim", "hyp_trim", F.col("improvement") * 100)
    stats = F.concat(comp, F.array(offset, F.format_string("Word counts: REF=%d | HYP=%d", F.size("ref"), F.size("hyp"))), _map_lines("words", "WordChanges", F.col("use_words"), counts[0]), _map_lines("numbers", "NumberChanges", F.col("use_numbers"), counts[1]))
    meta = F.col("metadata")
    head = F.array(
        F.concat(F.lit("Source JSON: "), "name", F.lit(".json")), F.concat(F.lit("Reference (GT): "), F.element_at(F.split("path", "/"), -1)),
        F.concat(F.lit("Mode: "), F.coalesce(meta["mode"], F.lit("unknown")), F.lit(" | Model: "), F.coalesce(meta["model"], F.lit("unknown")), F.lit(" | Backend: "), F.coalesce(meta["backend"], F.lit("unknown"))),
        F.concat(F.lit("Evaluation source: "), "source"),
        F.concat(F.lit("Range: start="), _shown(meta["start_seconds"]), F.lit(" | end="), _shown(meta["end_seconds"]), F.lit(" | chunk="), _shown(meta["chunk_seconds"]), F.lit("s | overlap="), _shown(meta["chunk_overlap_seconds"]), F.lit("s")),
        F.concat(F.lit("Runtime: "), F.coalesce(meta["runtime_seconds"].cast("string"), F.lit("n/a")), F.lit("s | Run started: "), F.coalesce(meta["run_started_utc"], F.lit("n/a")), F.lit(" | Run finished: "), F.coalesce(meta["run_finished_utc"], F.lit("n/a"))),
    )
    warning = E.length_warning(F.size("ref"), F.size("hyp"))
    rows = rows.withColumn("head", head).withColumn("stats", stats).withColumn("warnings", F.when(warning.isNull(), F.array().cast("array<string>")).otherwise(F.array(warning)))
    rows = kept(rows)
    sections_text = reports.text_report(rows, keys)
    metrics = ["recording", "source", "hits", "sub", "ins", "del", "wer", "words_replaced", "numbers_replaced", "comp_wer", "use"]
    return rows.select(*keys, F.col("priority").alias("section"), *metrics).join(sections_text, keys)


def text_reports(evaluated: DataFrame) -> DataFrame:
    """One report per hypothesis: file (its name) and report, sections in order."""
    return reports.appended(evaluated.select("name", "section", "report"), ["name"]).select(T.safe_file_name(F.col("name")).alias("file"), "report")


# ---- speaker evaluation ------------------------------------------------------------------------------------------------


def evaluate_speakers(spark: SparkSession, hypothesis_paths: str | list[str], speaker_paths: str | list[str], words: DataFrame | None = None, numbers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rates of both mappings with name, path, mapping, role; confidence of the mapping; reports).

    Truth files hold {recording: {role: segment}}; those without both roles give nothing.
    """
    from voxframe.operators import alignment as A

    files = transcripts.read_text(spark, hypothesis_paths)
    heads = hypotheses.hypotheses(files).select("name", "recording", "is_whisper", "metadata")
    channels = hypotheses.speaker_transcriptions(files, ["name"]).where("text <> ''")
    truth_files = transcripts.read_text(spark, speaker_paths)
    keys = ["name", "path"]
    sources = transcripts.ground_truth_sources(truth_files.select(F.regexp_replace("name", "_gt_speakers$", "_gt_segments").alias("name"), "path"), heads.select("recording").distinct()).select("recording", "path")
    sections = heads.join(sources, "recording")
    top = F.from_json("text", "map<string, map<string, struct<text: string>>>")
    told = truth_files.select("path", F.explode(top).alias("_key", "_roles")).select("path", "_key", F.explode("_roles").alias("role", "_s")).select("path", "_key", "role", T.clean_text(F.col("_s.text")).alias("text")).where("text <> ''")
    whole = told.groupBy("path", "_key").agg(F.count_distinct(F.when(F.col("role").isin(*G.V.EVAL_ROLES), F.col("role"))).alias("_n")).where("_n = 2").groupBy("path").agg(F.min("_key").alias("_first"))
    own = sections.join(told.select("path", F.col("_key").alias("recording"), F.lit(True).alias("_own")).distinct(), ["path", "recording"], "left").join(whole, "path", "left")
    chosen = own.withColumn("_key", F.when(F.col("_own"), F.col("recording")).otherwise(F.col("_first")))
    roles = chosen.select(*keys, "_key").join(told, ["path", "_key"]).select(*keys, "role", "text")
    mapped = G.assign_roles(channels.join(sections.select(*keys), "name"), roles, keys)
    ids = [*keys, "mapping", "role"]
    pairs = mapped.join(sections.select(*keys, "recording", "is_whisper", "metadata"), keys).withColumn("ref", T.tokens(T.normalize_text(F.col("ref")))).withColumn("hyp", T.tokens(T.normalize_text(F.col("hyp"))))
    rows = kept(A.with_alignment(kept(pairs.withColumn("use_words", F.lit(True)))))
    rows = kept(_optional(rows, "is_whisper", numbers, ids, "numbers"))
    rows = kept(_optional(rows, "use_words", words, ids, "words"))
    meta = F.col("metadata")
    # The labels of the report's first lines.
    head = F.array(
        F.concat(F.lit("Source JSON: "), "name", F.lit(".json")),
        F.concat(F.lit("Reference (GT): "), F.element_at(F.split("path", "/"), -1)),
        F.concat(F.lit("Recording ID: "), F.coalesce("recording", F.lit("unknown"))),
        F.concat(F.lit("Mode: "), F.coalesce(meta["mode"], F.lit("unknown")), F.lit(" | Model: "), F.coalesce(meta["model"], F.lit("unknown")),
                 F.lit(" | Backend: "), F.coalesce(meta["backend"], F.lit("unknown"))),
        F.concat(F.lit("Runtime: "), F.coalesce(meta["runtime_seconds"].cast("string"), F.lit("n/a")), F.lit("s | Run started: "),
                 F.coalesce(meta["run_started_utc"], F.lit("n/a")), F.lit(" | Run finished: "), F.coalesce(meta["run_finished_utc"], F.lit("n/a"))),
    )
    entries = [0 if m is None else m.count() for m in (words, numbers)]
    on = [F.lit(entries[0] > 0), F.col("is_whisper") & F.lit(entries[1] > 0)]
    stats = F.concat(_map_lines("words", "WordChanges", on[0], entries[0]), _map_lines("numbers", "NumberChanges", on[1], entries[1]))
    rows = kept(rows.withColumn("head", head).withColumn("stats", stats))
    rates = rows.select(*ids, "channel", "hits", "sub", "ins", "del", "wer", F.size("ref").alias("ref_words"), F.size("hyp").alias("hyp_words"))
    return rates, E.mapping_confidence(rates, keys), reports.speaker_report(rows, keys)


# ---- ground truth ------------------------------------------------------------------------------------------------------


def _truth_json(segments: DataFrame, recording: str) -> DataFrame:
    """recording, value: {recording: [segments in order, then the full transcript]}."""
    full = G.full_transcript(segments, recording)
    fields = ["id", "speakers", "start", "end", "text", "is_overlap"]
    listed = segments.select(recording, "seq", F.struct(*fields).alias("s")).unionByName(full.select(recording, F.lit(2**31 - 1).alias("seq"), F.struct(*fields).alias("s")))
    rows = listed.groupBy(recording).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "s"))), lambda x: x["s"]).alias("r"))
    return rows.select(recording, F.to_json(F.create_map(F.col(recording), F.col("r")), {"pretty": "true"}).alias("value"))


def _speakers_json(segments: DataFrame, recording: str) -> DataFrame:
    summary = G.speaker_summary(segments, recording)
    one = F.struct("role", F.struct("id", F.array("role").alias("speakers"), "start", "end", "text", F.lit(False).alias("is_overlap")).alias("s"))
    rows = summary.groupBy(recording).agg(F.map_from_entries(F.array_sort(F.collect_list(one))).alias("m"))
    return rows.select(recording, F.to_json(F.create_map(F.col(recording), F.col("m")), {"pretty": "true"}).alias("value"))


def annotated_truth(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(segments, speakers) as JSON per recording, of annotated XML transcripts."""
    segments = G.eval_reference(transcripts.annotated_segments(transcripts.read_text(spark, paths)), "recording")
    return _truth_json(segments, "recording"), _speakers_json(segments, "recording")


def formal_truth(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The same of formal transcripts; recordings are their parts, without a full transcript."""
    rows = G.formal_segments(transcripts.formal_rows(transcripts.read_text(spark, paths)), "recording_key").withColumnRenamed("recording_key", "recording")
    fields = F.struct("id", "speakers", "start", "end", "text", "is_overlap")
    listed = rows.groupBy("recording").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", fields.alias("s")))), lambda x: x["s"]).alias("r"))
    segments = listed.select("recording", F.to_json(F.create_map("recording", "r"), {"pretty": "true"}).alias("value"))
    return segments, _speakers_json(rows.withColumn("text_by_speaker", F.lit(None).cast("map<string, string>")), "recording")


# ---- recogniser output and audio ---------------------------------------------------------------------------------------


def assemble_hypotheses(segments: DataFrame, metadata: DataFrame, split: bool) -> DataFrame:
    """Raw segments (recording, speaker, seq, start, end, text) of one or two channels to recogniser output as JSON."""
    cleaned = segments.withColumn("text", T.clean_segment(F.col("text"))).where("text <> ''")
    folded = folds.postprocess(cleaned, ["recording", "speaker"] if split else ["recording"])
    merged = folds.cross_channel(folded) if split else folded
    return hypotheses.hypothesis_json(G.enrich(merged, ["recording"], split), metadata, ["recording"])


def recognise(
    spark: SparkSession, paths: str | list[str], load: Callable, model: str, backend: str, split: bool = True, packed: bool = True,
    start: float | None = None, end: float | None = None, chunk_seconds: float | None = None, options: dict | None = None,
) -> DataFrame:
    """WAV files to recogniser output: recording, file (its name, without suffix), value (JSON).

    load() gives the model, once per task. split: two channels, Speaker_L and Speaker_R, without what both heard; else the
    mean of all. packed: chunks of speech without its pauses and a model that gives segments; else chunks of speech windows
    and a model that gives texts. The metadata hold when the run began and ended and how long it took, measured around the
    recognition. Recordings in which nothing was said have no segments and empty texts.
    """
    lo, hi = G.check_window(start, end)
    began, clock = datetime.now(timezone.utc), time.perf_counter()
    loaded = audio.load(transcripts.read_files(spark, paths), "stereo" if split else "mean", lo, hi)
    sound = kept(recognition.channels(loaded, {"Speaker_L": "left", "Speaker_R": "right"} if split else {"unknown": "samples"}))
    seconds = chunk_seconds or (V.PACKED_CHUNK_SECONDS if packed else V.PLAIN_CHUNK_SECONDS)
    if packed:
        said = recognition.by_packed_speech(sound, load, seconds, V.DECODING if options is None else options)
        said = said.withColumn("text", T.clean_segment(F.col("text"))).where(F.col("text") != "").where(~T.is_hallucination(F.col("text")))
        said = folds.postprocess(said, recognition.KEYS)
    else:
        said = recognition.by_chunks(sound, load, seconds, options=options)
    said = kept(said)
    merged = kept(G.enrich(folds.cross_channel(said) if split else said, ["recording"], split))
    took, ended = round(time.perf_counter() - clock, 2), datetime.now(timezone.utc)
    fields = {
        "mode": "INDIVIDUAL_SPLIT" if split else "MIX", "start_seconds": lo, "end_seconds": hi, "has_custom_range": lo is not None or hi is not None,
        "model": model, "backend": backend, "chunk_seconds": seconds, "chunk_overlap_seconds": V.CHUNK_OVERLAP_SECONDS if packed else None,
        "chunk_backshift_seconds": None if packed else V.CHUNK_BACKSHIFT_SECONDS, "dedup_time_tolerance": V.CHANNEL_DEDUP_SECONDS,
        "adjacent_merge_gap_seconds": V.MERGE_GAP_SECONDS if packed else None, "vad_min_dur": V.VAD["min_dur"], "vad_max_dur": V.VAD["max_dur"],
        "vad_max_silence": V.VAD["max_silence"], "vad_energy_threshold": V.VAD["threshold"], "runtime_seconds": took,
        "run_started_utc": began.isoformat(), "run_finished_utc": ended.isoformat(),
    }
    kinds = {f.name: f.dataType for f in StructType.fromDDL(f"m {hypotheses.METADATA}")["m"].dataType}
    metadata = F.struct(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in fields.items()])
    recordings = sound.select("recording").distinct().withColumn("metadata", metadata)
    spoken = said.groupBy("recording").agg(*[F.expr(f"listagg(text, ' ') WITHIN GROUP (ORDER BY start, end, seq) FILTER (WHERE speaker = '{s}')").alias(s) for s in ("Speaker_L", "Speaker_R")])
    extra = {"Speaker_L_full_transcription": "Speaker_L", "speaker_R_full_transcription": "Speaker_R"} if split else {}
    values = hypotheses.hypothesis_json(merged, recordings, ["recording"], spoken if split else None, extra)
    scope = "full" if lo is None and hi is None else "range"
    return values.select("recording", F.concat("recording", F.lit(f"_{scope}_{backend}")).alias("file"), "value")


def process_audio(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(WAV files of left, right and mix; figures and report) of stereo recordings, levelled."""
    loaded = audio.load(transcripts.read_files(spark, paths), "stereo")
    done = kept(signal.process_stereo(loaded, ["name", "rate"]))
    files = None
    for channel in ("left", "right", "mix"):
        one = audio.to_wav(done.select(F.concat("name", F.lit(f"_{channel}")).alias("name"), "rate", F.col(channel)), [channel])
        files = one if files is None else files.unionByName(one)
    figures = done.select("name", F.col("name").alias("source"), "rate", F.size("mix").alias("n"), *signal.FIGURES)
    return files, figures.join(reports.signal_report(figures, ["name"]), "name")

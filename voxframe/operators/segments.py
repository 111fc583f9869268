"""Relational segment operators: windows, clipping, identity, references, formal transcripts, packing maps.

Segments are rows; ``seq`` is a segment's place in its recording, as a DataFrame has no order of its own. Texts are
joined in that order. Text functions treat null as empty; a segment without numeric times is kept whole by windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions import fixed_values as V
from voxframe.functions import text as T


def joined(text: str, order: str = "seq") -> Column:
    """Texts of a group, in order, with single blanks."""
    return F.expr(f"listagg({text}, ' ') WITHIN GROUP (ORDER BY {order})")


# ---- windows -----------------------------------------------------------------------------------------------------------


def in_window(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Whether a segment overlaps the half-open window [lo, hi); nulls are open ends, and a segment without start stays."""
    both = ~(lo.isNotNull() & (end <= lo)) & ~(hi.isNotNull() & (start >= hi))
    begun = ~(lo.isNotNull() & (start < lo)) & ~(hi.isNotNull() & (start >= hi))
    return F.when(start.isNull(), True).when(end.isNull(), F.coalesce(begun, F.lit(True))).otherwise(F.coalesce(both, F.lit(True)))


def clip_by_ratio(text: Column, start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """The words of a text that fall into the window if words are spread evenly over the segment."""
    words = T.tokens(text)
    n = F.size(words).cast("double")
    a, b = F.coalesce(lo, start), F.coalesce(hi, end)
    first, last = F.greatest(start, a), F.least(end, b)
    length = end - start
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (last - first) / length))
    left = F.greatest(F.lit(0.0), first - start) / length
    right = F.greatest(F.lit(0.0), end - last) / length
    i = F.greatest(F.lit(0), F.least(F.bround(n * left, 0).cast("int"), F.size(words) - 1))
    j = F.greatest(i + 1, F.least(F.bround(n * (1.0 - right), 0).cast("int"), F.size(words)))
    whole = (ratio >= 0.98) | (lo.isNull() & hi.isNotNull() & (end <= hi + V.WINDOW_OVERFLOW_SECONDS))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "")
        .when((lo.isNull() & hi.isNull()) | start.isNull() | end.isNull() | (end <= start), text)
        .when((b <= a) | (last <= first), "")
        .when(whole, text)
        .when((ratio <= 0.02) | (F.size(words) == 0), "")
        .otherwise(F.array_join(F.slice(words, i + 1, j - i), " "))
    )


def window_text(segments: DataFrame, keys: list[str], lo: Column, hi: Column) -> DataFrame:
    """Per group the text inside the window, clipped."""
    text = T.clean_text(F.col("text"))
    rows = segments.select(*keys, "seq", "start", "end", text.alias("text"), lo.alias("_lo"), hi.alias("_hi"))
    window = (F.col("start"), F.col("end"), F.col("_lo"), F.col("_hi"))
    rows = rows.where((F.col("text") != "") & in_window(*window)).withColumn("text", clip_by_ratio(F.col("text"), *window)).where("text <> ''")
    return rows.groupBy(*keys).agg(joined("text").alias("text"))


def check_window(lo: float | None, hi: float | None) -> tuple[float | None, float | None]:
    if (lo is not None and lo < 0) or (hi is not None and hi < 0):
        raise ValueError("a window starts and ends at 0 or later")
    if lo is not None and hi is not None and hi <= lo:
        raise ValueError("a window ends after its start")
    return lo, hi


def eval_window(full: Column, start: Column, end: Column, limit: Column) -> Column:
    """struct(lo, hi) of a run: none for full runs, else its range, with the limit in place of a missing end."""
    return F.struct(F.when(~full, start).alias("lo"), F.when(~full, F.coalesce(end, limit)).alias("hi"))


# ---- identity ----------------------------------------------------------------------------------------------------------


def is_full_transcript(id_: Column) -> Column:
    return F.coalesce(id_, F.lit("")).rlike(r"(?s)^full_.+_transcript\z")


def of_recording(segments: DataFrame, recording: str, partition: list[str]) -> DataFrame:
    """Segments whose id names the recording; where a group has none, all of it (fallback_used says so)."""
    named = F.coalesce(F.col("id"), F.lit("")).startswith(F.concat(F.lit("seg_"), F.col(recording), F.lit("_")))
    some = segments.withColumn("_named", named)
    any_ = some.groupBy(*partition).agg(F.max("_named").alias("_any"))
    return some.join(any_, partition).where(F.col("_named") | ~F.col("_any")).withColumn("fallback_used", ~F.col("_any")).drop("_named", "_any")


def full_reference(segments: DataFrame, recording: str) -> DataFrame:
    """Per recording the text of its full transcript, by its own id or else the first that looks like one."""
    own = F.col("id") == F.concat(F.lit("full_"), F.col(recording), F.lit("_transcript"))
    rows = segments.where(is_full_transcript(F.col("id")))
    return rows.groupBy(recording).agg(F.min_by(F.struct(T.clean_text(F.col("text")).alias("text"), "id"), F.struct(~own, F.col("seq"))).alias("f")).select(recording, "f.text", "f.id")


def enrich(segments: DataFrame, keys: list[str], split: bool = False) -> DataFrame:
    """Numbered segments of the output schema; split: with a speaker each."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "seq"))
    speaker = F.coalesce(F.col("speaker"), F.lit("unknown"))
    columns = [T.segment_id("asr", number).alias("id"), *([speaker.alias("speaker")] if split else []), F.array(speaker).alias("speakers"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.col("text"), F.lit(False).alias("is_overlap")]
    return segments.select(*keys, *columns)


# ---- ground truth ------------------------------------------------------------------------------------------------------


def role_rank(role: Column) -> Column:
    rank = F.lit(99)
    for k, name in reversed(list(enumerate(V.EVAL_ROLES))):
        rank = F.when(role == name, k).otherwise(rank)
    return rank


def make_segments(events: DataFrame, keys: list[str]) -> DataFrame:
    """Text events (keys, piece, seq, start, end, speaker, text) become segments: a speaker's texts joined, speakers in
    order of role and first appearance, their texts one after the other. Pieces without text or ending before their
    start are left out before segments are numbered."""
    said = events.withColumn("text", T.clean_for_asr(F.col("text"))).where((F.col("text") != "") & (F.col("end") >= F.col("start")))
    each = said.groupBy(*keys, "piece", "speaker").agg(F.first("start").alias("start"), F.first("end").alias("end"), F.min("seq").alias("seq"), joined("text").alias("text"))
    one = F.struct(role_rank(F.col("speaker")).alias("rank"), "seq", "speaker", "text")
    rows = each.groupBy(*keys, "piece").agg(F.first("start").alias("start"), F.first("end").alias("end"), F.array_sort(F.collect_list(one)).alias("r"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("piece"))
    overlap = F.size("r") > 1
    return rows.select(
        *keys, number.alias("seq"), T.segment_id("seg", number).alias("id"), F.col("r.speaker").alias("speakers"),
        F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.array_join("r.text", " ").alias("text"), overlap.alias("is_overlap"),
        F.when(overlap, F.map_from_arrays("r.speaker", "r.text")).alias("text_by_speaker"),
    )


def eval_reference(segments: DataFrame, recording: str) -> DataFrame:
    """Segments of the evaluated roles, ids with the recording's name, exact repetitions dropped."""
    roles = F.array(*map(F.lit, V.EVAL_ROLES))
    mine = F.array_intersect("speakers", roles)
    split = F.col("is_overlap") & F.col("text_by_speaker").isNotNull()
    texts = F.filter(F.transform(roles, lambda r: F.struct(r.alias("role"), F.when(F.array_contains("speakers", r), T.clean_for_asr(F.try_element_at("text_by_speaker", r))).alias("text"))), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    rows = segments.withColumn("_mine", mine).withColumn("_t", F.when(split, texts)).where(F.size("_mine") > 0)
    rows = rows.withColumn("text", F.when(split, F.array_join("_t.text", " ")).otherwise(T.clean_for_asr(F.col("text")))).where("text <> ''")
    rows = rows.withColumn("speakers", F.when(split, F.col("_t.role")).otherwise(F.col("_mine")))
    rows = rows.withColumn("is_overlap", F.size("speakers") > 1).withColumn("text_by_speaker", F.when(split & (F.size("speakers") > 1), F.map_from_arrays("_t.role", "_t.text")))
    rows = rows.withColumn("id", F.when(F.col("id").startswith("seg_"), T.rewrite_id(F.col("id"), F.col(recording))).otherwise(F.col("id")))
    return exact_dedup(rows.drop("_mine", "_t"), [recording])


def exact_dedup(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Of segments with equal times, speakers and normalised text the first."""
    same = Window.partitionBy(*keys, "start", "end", "speakers", T.normalize_for_dedup(F.col("text"))).orderBy("seq")
    return segments.withColumn("_k", F.row_number().over(same)).where("_k = 1").drop("_k")


def full_transcript(segments: DataFrame, recording: str) -> DataFrame:
    rows = segments.withColumn("text", T.clean_for_asr(F.col("text")))
    out = rows.groupBy(recording).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.expr("listagg(nullif(text, ''), ' ') WITHIN GROUP (ORDER BY seq)").alias("text"))
    return out.where("text is not null").select(
        recording, F.concat(F.lit("full_"), F.col(recording), F.lit("_transcript")).alias("id"), F.array(*map(F.lit, V.EVAL_ROLES)).alias("speakers"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text", F.lit(False).alias("is_overlap")
    )


def speaker_summary(segments: DataFrame, recording: str) -> DataFrame:
    """Per recording and evaluated role all it said; times are the whole recording's."""
    span = segments.groupBy(recording).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    split = F.col("is_overlap") & F.col("text_by_speaker").isNotNull()
    said = F.transform(F.array(*map(F.lit, V.EVAL_ROLES)), lambda r: F.struct(r.alias("role"), F.when(split, F.try_element_at("text_by_speaker", r)).when(F.col("speakers") == F.array(r), F.col("text")).alias("text")))
    rows = segments.select(recording, "seq", F.inline(said)).withColumn("text", T.clean_for_asr(F.col("text"))).where("text <> ''")
    texts = rows.groupBy(recording, "role").agg(joined("text").alias("text"))
    return texts.join(span, recording).select(recording, "role", F.concat(F.lit("full_"), F.col(recording), F.lit("_"), F.col("role")).alias("id"), F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


# ---- formal transcripts ------------------------------------------------------------------------------------------------


def default_duration(rows: DataFrame, recording: str) -> DataFrame:
    """Per recording the median of its positive gaps between starts, from 0.5 to 10 seconds; 3 without gaps."""
    gap = F.lead("start").over(Window.partitionBy(recording).orderBy("start", "seq")) - F.col("start")
    gaps = rows.select(recording, gap.alias("gap")).groupBy(recording).agg(F.median(F.when(F.col("gap") > 0, F.col("gap"))).alias("m"))
    return gaps.select(recording, F.when(F.col("m").isNull(), 3.0).otherwise(F.least(F.lit(10.0), F.greatest(F.lit(0.5), F.col("m")))).alias("duration"))


def formal_segments(rows: DataFrame, recording: str) -> DataFrame:
    """Rows with a start each become segments that end where the next one starts."""
    by = Window.partitionBy(recording).orderBy("start", "seq")
    nth, following = F.row_number().over(by), F.lead("start").over(by)
    out = rows.withColumn("n", nth).withColumn("_next", following).join(default_duration(rows, recording), recording)
    end = F.when(F.col("_next").isNull(), F.col("start") + F.col("duration")).otherwise(F.greatest(F.col("start") + 0.001, F.col("_next")))
    return out.select(recording, T.segment_id("seg", F.col("n"), F.col(recording)).alias("id"), F.col("n").alias("seq"), F.array("speaker").alias("speakers"), F.round("start", 3).alias("start"), F.round(end, 3).alias("end"), "text", F.lit(False).alias("is_overlap"))


def part_offsets(rows: DataFrame, recording: str) -> DataFrame:
    """Per part the sum of the latest starts of all parts before it."""
    latest = rows.groupBy(recording, "part").agg(F.greatest(F.lit(0.0), F.max("start")).alias("latest"))
    before = Window.partitionBy(recording).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return latest.select(recording, "part", F.coalesce(F.sum("latest").over(before), F.lit(0.0)).alias("offset"))


# ---- packing -----------------------------------------------------------------------------------------------------------


def vad_parts(windows: DataFrame) -> DataFrame:
    """Speech windows clamped to the recording; empty ones go. windows has start, end, duration."""
    return windows.withColumn("start", F.greatest(F.lit(0.0), "start")).withColumn("end", F.least("duration", "end")).where(F.col("end") > F.col("start"))


def packed_map(parts: DataFrame, keys: list[str], rate: int = 16000, gap: float = V.PACK_GAP_SECONDS) -> DataFrame:
    """Where parts lie once they are put one after the other with gaps between them. Lengths are whole samples."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    samples = F.floor(F.col("end") * rate) - F.floor(F.col("start") * rate)
    rows = parts.withColumn("_n", samples).withColumn("idx", F.row_number().over(by) - 1).where("_n > 0")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    quiet = int(gap * rate)
    packed = (F.coalesce(F.sum("_n").over(before), F.lit(0)) + F.col("idx") * quiet) / float(rate)
    return rows.withColumn("_at", packed).select(*keys, F.col("idx"), F.col("_at").alias("packed_start"), (F.col("_at") + F.col("_n") / float(rate)).alias("packed_end"), F.col("start").alias("original_start"), F.col("end").alias("original_end"))


def to_original(offsets: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """offsets (keys, id, offset) with ``original``: times in packed audio back on the recording's own line.

    An as-of join without a range join: parts and offsets of a group in one order, each offset seeing the last part that
    starts before it. At a shared edge the earlier part counts; in a gap the end of the part before.
    """
    part = "struct<ps: double, pe: double, os: double, oe: double>"
    one = F.struct(F.col("packed_start").alias("ps"), F.col("packed_end").alias("pe"), F.col("original_start").alias("os"), F.col("original_end").alias("oe"))
    b = parts.withColumn("_p", one).withColumn("_prev", F.lag("_p").over(Window.partitionBy(*keys).orderBy("packed_start")))
    b = b.select(*keys, F.lit(None).cast(offsets.schema["id"].dataType).alias("id"), F.lit(None).cast("double").alias("offset"), F.col("packed_start").alias("_t"), F.lit(0).alias("_kind"), F.struct("_p", "_prev").alias("_s"))
    t = F.greatest(F.lit(0.0), F.col("offset"))
    a = offsets.select(*keys, "id", F.col("offset"), t.alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(f"struct<_p: {part}, _prev: {part}>").alias("_s"))
    by = Window.partitionBy(*keys).orderBy("_t", "_kind")
    seen = F.last("_s", True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("_s", True).over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = a.unionByName(b).withColumn("_seen", seen).withColumn("_first", first).where("_kind = 1")
    rows = rows.withColumn("_at", F.when(F.col("_seen._prev.pe") >= F.col("_t"), F.col("_seen._prev")).otherwise(F.col("_seen._p")))
    inside = F.least(F.col("_at.oe"), F.greatest(F.col("_at.os"), F.col("_at.os") + F.col("_t") - F.col("_at.ps")))
    return rows.select(*keys, "id", "offset", F.when(F.col("_at").isNotNull(), inside).when(F.col("_first").isNotNull(), F.col("_first._p.os")).otherwise(F.col("offset")).alias("original"))


def packed_to_absolute(segments: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """segments (keys, id, start, end within a chunk of packed audio, chunk_start, chunk_end, base, ...) with their times on
    the recording's line: clamped to the chunk, put back where the parts came from, moved by ``base``, the place of the
    audio in its recording. What is empty in the chunk goes. ids are unique within keys."""
    inside = lambda c: F.col("chunk_start") + F.greatest(F.lit(0.0), F.least(F.col(c), F.col("chunk_end") - F.col("chunk_start")))
    rows = segments.withColumn("_a", inside("start")).withColumn("_b", inside("end")).where("_b > _a")
    edges = rows.select(*keys, F.col("id").alias("_id"), F.explode(F.array("_a", "_b")).alias("offset")).select(*keys, F.struct("_id", "offset").alias("id"), "offset")
    placed = to_original(edges, parts, keys).groupBy(*keys, F.col("id._id").alias("id")).agg(F.min_by("original", "offset").alias("_s"), F.max_by("original", "offset").alias("_e"))
    out = rows.drop("_a", "_b", "start", "end").join(placed, [*keys, "id"])
    return out.withColumn("start", F.col("base") + F.col("_s")).withColumn("end", F.col("base") + F.col("_e")).drop("_s", "_e")


def fixed_chunks(recordings: DataFrame, keys: list[str], seconds: float = 360.0) -> DataFrame:
    """recordings (keys, duration) cut at multiples of ``seconds``."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration") / seconds).cast("int") - 1, F.lit(0)))
    rows = recordings.where("duration > 0").select(*keys, "duration", F.explode(steps).alias("chunk"))
    return rows.select(*keys, "chunk", (F.col("chunk") * seconds).alias("start"), F.least(F.col("duration"), (F.col("chunk") + 1) * seconds).alias("end"))


def backshift(chunks: DataFrame, keys: list[str], seconds: float = 1.0) -> DataFrame:
    """Where decoding of each chunk begins: a little before it, but for the first one."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end"))
    return chunks.withColumn("chunk", nth).withColumn("decode_start", F.when(F.col("chunk") > 1, F.greatest(F.lit(0.0), F.col("start") - seconds)).otherwise(F.col("start")))


def to_absolute(segments: DataFrame) -> DataFrame:
    """Chunk-relative times onto the recording's line, clamped to the chunk; what is then empty goes.

    segments has start, end, chunk_start, chunk_end.
    """
    put = lambda c: F.least(F.col("chunk_end"), F.greatest(F.col("chunk_start"), F.col("chunk_start") + F.col(c)))
    return segments.withColumn("_a", put("start")).withColumn("_b", put("end")).where("_b > _a").withColumn("start", F.col("_a")).withColumn("end", F.col("_b")).drop("_a", "_b")


# ---- roles and channels ------------------------------------------------------------------------------------------------


def channel_texts(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and speaker its whole text."""
    rows = segments.withColumn("text", T.clean_text(F.col("text"))).where("text <> ''")
    return rows.groupBy(*keys, F.lower("speaker").alias("channel")).agg(joined("text").alias("text"))


def assign_roles(channels: DataFrame, roles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, role, channel, mapping: the shortest text of either side belongs together and so does the longest
    ("length"), or the other way round ("swapped"). Groups need two channels and both roles."""
    size = F.length("text")
    up, down = (F.row_number().over(Window.partitionBy(*keys).orderBy(order, name)) for order, name in ((size.asc(), "channel"), (size.desc(), F.desc("channel"))))
    c = channels.withColumn("_up", up).withColumn("_down", down)
    c = c.where("_up = 1 OR _down = 1").where("NOT (_up = 1 AND _down = 1)").withColumn("rank", F.when(F.col("_up") == 1, 0).otherwise(1)).select(*keys, "rank", "channel", F.col("text").alias("hyp"))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(size, "role"))
    many = F.count("*").over(Window.partitionBy(*keys))
    r = roles.where(F.col("role").isin(*V.EVAL_ROLES)).withColumn("rank", first - 1).withColumn("_n", many).where("_n = 2").select(*keys, "rank", "role", F.col("text").alias("ref"))
    both = c.select("*", F.explode(F.array(F.lit("length"), F.lit("swapped"))).alias("mapping"))
    both = both.withColumn("rank", F.when(F.col("mapping") == "swapped", 1 - F.col("rank")).otherwise(F.col("rank")))
    return r.join(both, [*keys, "rank"]).select(*keys, "mapping", "role", "channel", "ref", "hyp")

"""Chat formatting by multi-party perspective rotation, with DataFrame functions alone.

For every participant of a conversation the dialogue is rendered with that speaker as assistant and the others as named
users; only the assistant's words and the end mark after them are to be learned. The rendering comes as segments, one
per perspective and turn, each with its place in the rendered dialogue, so that a conversation of any length is never
held by one task; ``dialogues`` joins segments into whole strings where conversations are known to be short.

Places are prefix sums in two levels: inside stretches of STRETCH turn numbers, and over the stretches.

Texts and roles are rendered as they are: marks inside a text are not escaped, and it is the rows, starts and masks that
tell turns apart, not a search for marks in a dialogue.

Defined results: a null text is empty; a null role is a speaker named "unknown"; null turns come first; turns of equal
number are ordered by role and text; repeated rows are rendered as often as they are there; speakers whose only rows are
system turns have no perspective, and a conversation of system turns alone gives none; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
END = "<|end|>\n"
STRETCH = 256


def rotate(conversations: DataFrame, system: str = SYSTEM, end: str = END, stretch: int = STRETCH) -> DataFrame:
    """conv_id, perspective, turn, role, segment, start, mask_start, mask_end (null where nothing is to be learned).

    start is the segment's first code point in its dialogue; [mask_start, mask_end) are code points of the dialogue.
    """
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    speakers = turns.where(F.col("role") != system).select("conv_id", F.col("role").alias("perspective")).distinct()
    both = turns.join(speakers.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "inner").drop("_c")
    own = F.col("role") == F.col("perspective")
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("role") == system, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), "role", F.lit("|>\n")))
    rendered = both.withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit(end))).withColumn("_n", F.length("segment").cast("long"))
    rendered = rendered.withColumn("_stretch", F.coalesce(F.floor(F.col("turn") / stretch), F.lit(-(2**62))))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    key = ["conv_id", "perspective"]
    inside = Window.partitionBy(*key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rendered.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    before = Window.partitionBy(*key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    bases = rendered.groupBy(*key, "_stretch").agg(F.sum("_n").alias("_sum")).select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("_stretch").alias("_s"), F.coalesce(F.sum("_sum").over(before.partitionBy("conv_id", "perspective")), F.lit(0)).alias("_base"))
    placed = placed.join(bases, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & (F.col("_stretch") == F.col("_s")))
    start = F.col("_base") + F.col("_in")
    mine = F.col("role") == F.col("perspective")
    return placed.select(
        "conv_id", "perspective", "turn", "role", "segment", start.alias("start"),
        F.when(mine, start + F.length("head")).alias("mask_start"),
        F.when(mine, start + F.length("segment")).alias("mask_end"),
    )


def dialogues(segments: DataFrame) -> DataFrame:
    """conv_id, perspective, text, masks: whole rendered dialogues. One conversation must fit in a task's memory."""
    rows = F.array_sort(F.collect_list(F.struct("start", "segment", "mask_start", "mask_end")))
    return (
        segments.groupBy("conv_id", "perspective")
        .agg(rows.alias("r"))
        .select("conv_id", "perspective", F.array_join(F.col("r.segment"), "").alias("text"), F.filter(F.transform("r", lambda x: F.struct(x["mask_start"].alias("first"), x["mask_end"].alias("end"))), lambda x: x["first"].isNotNull()).alias("masks"))
    )


def rotate_sql(system: str = SYSTEM) -> str:
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{system}'),
r AS (SELECT t.conv_id, perspective, turn, role, text,
  CASE WHEN role = perspective THEN '<|assistant|>' || chr(10) WHEN role = '{system}' THEN '<|system|>' || chr(10) ELSE '<|user name=' || role || '|>' || chr(10) END AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
g AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM r),
p AS (SELECT *, CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM g)
SELECT conv_id, perspective, turn, role, segment, start,
  CASE WHEN role = perspective THEN start + length(head) END AS mask_start,
  CASE WHEN role = perspective THEN start + length(segment) END AS mask_end FROM p"""

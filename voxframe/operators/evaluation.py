"""Error rates of hypothesis texts against references: correction, offset compensation, macro and weighted rates.

pairs are rows with keys, ref and hyp, arrays of normalised words. Each operator keeps them as rows, so any number of
recordings, sources, mappings and roles is evaluated in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions import fixed_values as V
from voxframe.functions import text as T
from voxframe.operators import alignment as A
from voxframe.plans.storage import kept

METRICS = ["hits", "sub", "ins", "del", "wer"]


def word_error_rates(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, distance, ref_words, hyp_words, wer. A least distance has one value, whatever the alignment."""
    d = pairs.withColumn("distance", A.word_distance("ref", "hyp"))
    n = F.size("ref")
    return d.select(*keys, "distance", n.alias("ref_words"), F.size("hyp").alias("hyp_words"), F.when(n > 0, F.col("distance") / n).alias("wer"))


def pooled(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of rates and their mean weighted by reference words, per group; 0 where there are no words."""
    n = F.sum("ref_words")
    return rates.groupBy(*keys).agg(F.avg("wer").alias("macro_wer"), F.when(n > 0, F.sum(F.col("wer") * F.col("ref_words")) / n).otherwise(0.0).alias("weighted_wer"), n.alias("ref_words"))


def corrected(pairs: DataFrame, mapping: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One dictionary pass: pairs with an alignment, hyp corrected where that is not worse.

    Adds name_checked, name_replaced, name_before, name_after and name_used. Pairs must hold hits.. and chunks of the
    present hyp, and get those of the accepted one. Only pairs in which a word changed are aligned again. Pairs are read
    several times: pass a written table.
    """
    tried = A.apply_variants(pairs, mapping, keys)
    changed = F.col("tokens_replaced") > 0
    # pairs in which nothing changed go through the UDF as nulls, at no cost, so that all rows are read once
    again = tried.withColumn("_u", A.align_words(F.when(changed, F.col("ref")), F.when(changed, F.col("corrected"))))
    both = again.withColumn("_n", F.when(changed, F.col("_u")).otherwise(F.struct(*[F.col(c) for c in [*METRICS, "chunks"]]).cast(A.RESULT_STRUCT)))
    use = F.col("_n.wer") <= F.col("wer")
    rest = [c for c in pairs.columns if c not in (*METRICS, "chunks", "hyp")]
    pick = lambda c: F.when(use, F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(
        *rest, F.when(use, F.col("corrected")).otherwise(F.col("hyp")).alias("hyp"), *map(pick, [*METRICS, "chunks"]),
        F.col("spans_checked").alias(f"{name}_checked"), F.col("tokens_replaced").alias(f"{name}_replaced"),
        F.col("wer").alias(f"{name}_before"), F.col("_n.wer").alias(f"{name}_after"), F.coalesce(use, F.lit(False)).alias(f"{name}_used"),
    )


def offset_compensation(pairs: DataFrame, keys: list[str], trims: int = V.OFFSET_TRIM_WORDS) -> DataFrame:
    """keys, base_wer, comp_wer, ref_trim, hyp_trim, improvement, prefix matches, use.

    Up to ``trims`` words are cut from the start of ref or hyp; what would empty a side is no candidate. The best has the
    least rate, then the longest matching start, then the first in order. One matrix of a pair holds all distances.
    """
    options = [(0, 0)] + [x for t in range(1, trims + 1) for x in ((t, 0), (0, t))]
    rows = pairs.select(*keys, "ref", "hyp").withColumn("_d", A.trims_udf(trims)("ref", "hyp"))

    def candidate(k: int, r: int, h: int):
        left = F.size("ref") - r
        said = F.try_element_at("_d.cut_hyp", F.lit(h + 1)) if h else F.try_element_at("_d.cut_ref", F.lit(r + 1))
        wer = F.when(left > 0, said / left).otherwise(0.0)
        cut = [T.drop_words(F.col(c), F.lit(n)) if n else F.col(c) for c, n in (("ref", r), ("hyp", h))]
        order = [wer.alias("wer"), (-T.prefix_matches(*cut)).alias("prefix"), F.lit(k).alias("k")]
        one = F.struct(*order, F.lit(r).alias("ref_trim"), F.lit(h).alias("hyp_trim"))
        return one if k == 0 else F.when((left > 0) & (F.size("hyp") > h), one)

    tries = F.array_compact(F.array(*[candidate(k, r, h) for k, (r, h) in enumerate(options)]))
    best = rows.select(*keys, tries.alias("t")).select(*keys, F.col("t")[0].alias("o"), F.array_min("t").alias("b"))
    gain = F.col("o.wer") - F.col("b.wer")
    trimmed = (F.col("b.ref_trim") + F.col("b.hyp_trim")) > 0
    use = trimmed & (gain >= V.OFFSET_IMPROVEMENT) & (F.col("b.prefix") <= F.col("o.prefix"))
    return best.select(
        *keys, F.col("o.wer").alias("base_wer"), F.col("b.wer").alias("comp_wer"), "b.ref_trim", "b.hyp_trim",
        gain.alias("improvement"), (-F.col("o.prefix")).alias("base_prefix"), (-F.col("b.prefix")).alias("comp_prefix"),
        use.alias("use"),
    )


def length_warning(ref_words, hyp_words):
    return F.when(hyp_words > 1.5 * ref_words, "hypothesis is over 1.5 times as long as the reference").when(hyp_words < 0.5 * ref_words, "hypothesis is under half as long as the reference")


def mapping_confidence(rates: DataFrame, keys: list[str]) -> DataFrame:
    """rates with mapping, wer, ref_words -> weighted rates of both mappings side by side and which is lower. The
    length-based mapping is what is reported either way."""
    sides = pooled(rates, [*keys, "mapping"]).groupBy(*keys).pivot("mapping", ["length", "swapped"]).agg(F.first("weighted_wer"))
    return sides.select(*keys, F.col("length").alias("length_wer"), F.col("swapped").alias("swapped_wer"), F.when(F.col("swapped") < F.col("length"), "swapped").otherwise("length").alias("winner"), ((F.col("swapped") - F.col("length")) * 100).alias("delta_points"))


def by_source(pairs: DataFrame, sources: DataFrame, recording: str) -> DataFrame:
    """Every hypothesis with every ground truth that exists for its recording, in order of priority."""
    return pairs.join(sources, recording).withColumn("section", F.row_number().over(Window.partitionBy(recording).orderBy("priority")))


def evaluate(pairs: DataFrame, keys: list[str], words: DataFrame | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """Alignment, then the number map, then the word map, each accepted if not worse."""
    rows = A.with_alignment(pairs)
    if numbers is not None:
        rows = corrected(kept(rows), numbers, keys, "numbers")
    if words is not None:
        rows = corrected(kept(rows), words, keys, "words")
    return rows

from __future__ import annotations

from pyspark.sql import functions as F
from voxframe.functions import sql
from voxframe.functions import text as T
from voxframe.operators import segments as G


def test_sql_names_equal_the_columns(spark):
    sql.register(spark)
    rows = [(" Hello,  [x] World-wide! \t", 0.0, 1.0), (None, None, 2.0), ("Děkuji za sledování a nashle", 1.0, None), ("titulky vytvořil X", 3.0, 4.0), ("Tys to", 2.5, 9.0)]
    spark.createDataFrame(rows, "t string, a double, b double").createOrReplaceTempView("said")
    got = spark.sql("SELECT vx_clean(t) c, vx_clean_for_asr(t) r, vx_normalize_common(t) n, vx_normalize_for_dedup(t) d, vx_words(t) w, vx_in_window(a, b, 1D, 3D) i, vx_word_distance(vx_words(t), array('zzz')) z FROM said")
    t = F.col("t")
    want = spark.table("said").select(T.clean_text(t).alias("c"), T.clean_for_asr(t).alias("r"), T.normalize_common(t).alias("n"), T.normalize_for_dedup(t).alias("d"), T.tokens(t).alias("w"), G.in_window(F.col("a"), F.col("b"), F.lit(1.0), F.lit(3.0)).alias("i"), F.greatest(F.size(T.tokens(t)), F.lit(1)).cast("long").alias("z"))
    assert got.collect() == want.collect()

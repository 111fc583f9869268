"""The engine's functions under SQL names: register(spark), then spark.sql("SELECT vx_words(text) FROM ...").

Text functions are SQL functions, which Catalyst puts in place of the call; alignment is an Arrow UDF.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import fixed_values as V
from .text import MARKS, SPACE


def _text(s: str) -> str:
    return "r'" + s.replace("'", "\\'") + "'" if "'" not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _without(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, {_text('(?idU)' + p)}, ' ')"
    return x


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, result, body)"""
    flat = lambda x: f"btrim(regexp_replace(coalesce({x}, ''), {_text(SPACE)}, ' '))"
    clean = f"regexp_replace(coalesce(x, ''), {_text(f'^{SPACE}|{SPACE}' + chr(92) + 'z')}, '')"
    dedup = flat(f"regexp_replace(lower(coalesce(x, '')), {_text(MARKS)}, ' ')")
    common = flat(f"regexp_replace(replace({_without(f'lower({clean})', V.HALLUCINATIONS)}, '-', ' '), {_text(MARKS)}, ' ')")
    return {
        "vx_clean": ("x STRING", "STRING", clean),
        "vx_clean_for_asr": ("x STRING", "STRING", flat(f"regexp_replace(coalesce(x, ''), {_text(r'(?d)\[.*?\]')}, '')")),
        "vx_normalize_common": ("x STRING", "STRING", common),
        "vx_normalize_for_dedup": ("x STRING", "STRING", dedup),
        "vx_words": ("x STRING", "ARRAY<STRING>", f"CASE WHEN {flat('x')} = '' THEN array() ELSE split({flat('x')}, ' ') END"),
        "vx_in_window": ("a DOUBLE, b DOUBLE, lo DOUBLE, hi DOUBLE", "BOOLEAN", "a IS NULL OR (coalesce(b > lo, true) OR b IS NULL) AND (b IS NOT NULL OR coalesce(a >= lo, true)) AND coalesce(a < hi, true)"),
        "vx_db": ("x DOUBLE", "DOUBLE", "20 * log10(greatest(x, 1e-12))"),
    }


def register(spark: SparkSession) -> None:
    from pyspark.sql.pandas.functions import arrow_udf

    from voxframe.operators import alignment

    for name, (parameters, result, body) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, f, kind in (("vx_align", alignment.align_words, alignment.RESULT), ("vx_word_distance", alignment.word_distance, "long")):
        spark.udf.register(name, arrow_udf(f.__wrapped__, kind))

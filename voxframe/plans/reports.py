"""Text reports, one row each: lines in a fixed order, joined by line ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions import fixed_values as V
from voxframe.functions import text as T
from voxframe.operators import alignment as A
from voxframe.operators import evaluation as E

WIDE = "=" * 80
THIN = "-" * 80


def percent(c: Column) -> Column:
    """Per cent with two decimals, halves to even; n/a where there is no rate."""
    return F.coalesce(F.format_string("%.2f %%", F.bround(c * 100, 2)), F.lit("n/a"))


def _lines(op: str, line) -> Column:
    """Top errors of a kind as lines, of rows with ``top``."""
    return F.transform(F.filter("top", lambda x: x["op"] == op), line)


def _examples() -> Column:
    """The most frequent substitution, deletion and insertion as lines, in this order."""
    lines = {
        "substitute": lambda x: F.format_string("SUB (%dx): '%s' -> '%s'", x["cnt"], x["ref_text"], x["hyp_text"]),
        "delete": lambda x: F.format_string("DEL (%dx): '%s'", x["cnt"], x["ref_text"]),
        "insert": lambda x: F.format_string("INS (%dx): '%s'", x["cnt"], x["hyp_text"]),
    }
    return F.concat(*[F.slice(_lines(op, line), 1, 1) for op, line in lines.items()])


def _say(*parts) -> Column:
    return F.array(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _none() -> Column:
    return F.array().cast("array<string>")


def _own(rows: DataFrame, name: str) -> Column:
    """A column of lines that rows may have."""
    return F.coalesce(name, _none()) if name in rows.columns else _none()


def _with_body(aligned: DataFrame) -> DataFrame:
    """aligned with ``body``: lines of counts, warnings, examples, beginnings and ends, and top errors of each row."""
    rows = A.with_own_top(aligned).withColumn("examples", _examples())
    warnings = _own(aligned, "warnings")
    listed = F.concat(_say("", "Warnings:"), F.transform(warnings, lambda x: F.concat(F.lit("- "), x)))
    warned = F.when(F.size(warnings) == 0, _none()).otherwise(listed)
    shown = F.col("examples")
    numbered = F.transform(shown, lambda x, i: F.format_string("%d. %s", i + 1, x))
    numbered = F.when(F.size(shown) == 0, _say("(Nenalezeny žádné ukázky)")).otherwise(numbered)
    ref, hyp = T.preview(F.col("ref")), T.preview(F.col("hyp"))
    said = lambda part: [F.concat(F.lit("REF: "), ref[part]), F.concat(F.lit("HYP: "), hyp[part])]
    # The labels of a report's lines.
    body = F.concat(
        _say(F.format_string("HITS: %d | SUB: %d | INS: %d | DEL: %d", "hits", "sub", "ins", "del")),
        warned,
        _say("", "Kvalitativní ukázky (2-3):"),
        numbered,
        _say("", "Začátek srovnání:", *said("head"), "", "Konec srovnání:", *said("tail")),
        _say("", "Top substitutions:"),
        _lines("substitute", lambda x: F.format_string("%dx | %s => %s", x["cnt"], x["ref_text"], x["hyp_text"])),
        _say("", "Top deletions:"),
        _lines("delete", lambda x: F.format_string("%dx | %s", x["cnt"], x["ref_text"])),
        _say("", "Top insertions:"),
        _lines("insert", lambda x: F.format_string("%dx | %s", x["cnt"], x["hyp_text"])),
    )
    return rows.withColumn("body", body)


def _joined(lines: Column) -> Column:
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def text_report(aligned: DataFrame, keys: list[str], title: str = "ASR Evaluation Report") -> DataFrame:
    """keys, report, a row for each of aligned. It has ref, hyp, hits, sub, ins, del, wer, chunks; it may have lines of its own
    as arrays: ``head`` before the figures, ``stats`` after the rate, ``warnings``. It is read once."""
    rows = _with_body(aligned)
    rate = F.concat(F.lit("WER: "), percent(F.col("wer")))
    lines = F.concat(_say(title, WIDE), _own(aligned, "head"), _say(THIN, rate), _own(aligned, "stats"), "body")
    return rows.select(*keys, _joined(lines).alias("report"))


def appended(sections: DataFrame, keys: list[str], order: str = "section", wide_lines: int = 2) -> DataFrame:
    """Sections of a report one after the other, with a divider of several lines between them."""
    divider = "\n" + f"{WIDE}\n" * wide_lines + "\n"
    rows = F.transform(F.array_sort(F.collect_list(F.struct(order, "report"))), lambda x: x["report"])
    return sections.groupBy(*keys).agg(F.array_join(rows, divider).alias("report"))


def speaker_report(aligned: DataFrame, keys: list[str], title: str = "ASR Speaker Evaluation Report") -> DataFrame:
    """keys, report. aligned has mapping, role, channel, ref, hyp, metrics and chunks of both mappings; it may have
    ``head`` and ``stats`` as in text_report. It is read several times: pass a written table."""
    rates = aligned.select(*keys, "mapping", "role", "channel", "wer", F.size("ref").alias("ref_words"))
    sure = E.mapping_confidence(rates, keys)
    told = rates.where("mapping = 'length'")
    pooled = E.pooled(told, keys).select(*keys, "macro_wer", "weighted_wer")
    by_role = lambda value, role: F.first(F.when(F.col("role") == role, F.col(value)), True)
    roles = V.EVAL_ROLES
    figures = [by_role(c, r).alias(f"{c}_{r}") for c in ("wer", "channel") for r in roles]
    by_roles = told.groupBy(*keys).agg(*figures)
    rows = _with_body(aligned.where("mapping = 'length'"))
    # The labels of a speaker's section and of the report.
    section = F.concat(
        _say(
            F.concat(F.lit("Speaker section: "), "role"),
            THIN,
            F.concat(F.lit("GT role: "), "role", F.lit(" | ASR source: "), "channel"),
            F.concat(F.lit("WER: "), percent(F.col("wer"))),
            F.format_string("Word counts: REF=%d | HYP=%d", F.size("ref"), F.size("hyp")),
        ),
        _own(aligned, "stats"),
        "body",
    )
    sections = rows.groupBy(*keys).agg(
        *[F.first(F.when(F.col("role") == r, section), True).alias(f"section_{r}") for r in roles],
        F.first(_own(aligned, "head")).alias("_head"),
    )
    out = by_roles.join(pooled, keys).join(sure, keys).join(sections, keys)
    number = lambda c: F.format_string("%.2f", F.bround(F.col(c), 2))
    confidence = F.concat(
        F.lit("Mapping confidence (weighted WER): length_based="),
        percent(F.col("length_wer")),
        F.lit(" | swapped="),
        percent(F.col("swapped_wer")),
        F.lit(" | winner="),
        F.when(F.col("winner") == "length", "length_based").otherwise(F.col("winner")),
        F.lit(" | delta="),
        number("delta_points"),
        F.lit(" p.b."),
    )
    lines = F.concat(
        _say(title, WIDE),
        "_head",
        _say("Evaluation source: speaker_full_transcriptions", "Speaker mapping by text length:"),
        _say(*[F.concat(F.lit(f"- {r} <= "), f"channel_{r}") for r in roles], confidence, THIN),
        _say(*[F.concat(F.lit(f"WER ({r}): "), percent(F.col(f"wer_{r}"))) for r in roles]),
        _say(F.concat(F.lit("WER (macro avg): "), percent(F.col("macro_wer")))),
        _say(F.concat(F.lit("WER (weighted by REF words): "), percent(F.col("weighted_wer")))),
        *[x for r in roles for x in (_say("", WIDE, ""), F.col(f"section_{r}"))],
    )
    return out.select(*keys, _joined(lines).alias("report"))


def signal_report(figures: DataFrame, keys: list[str]) -> DataFrame:
    """keys, report. figures has source, rate, n and the columns of operators.signal.FIGURES."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.bround(F.col(c), n))
    db = lambda label, c, unit: F.concat(F.lit(label), fixed(c, 2), F.lit(unit))
    gain = lambda label, c: F.concat(F.lit(label), fixed(c, 6))
    loud = lambda label, c: F.concat(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit("None")))
    duration = F.format_string("%.2f", F.bround(F.col("n") / F.col("rate"), 2))
    # The labels of the report's lines and its explanations.
    lines = _say(
        "Signal Processing Report",
        "========================",
        F.concat(F.lit("Source: "), "source"),
        F.concat(F.lit("Sample rate: "), F.col("rate").cast("string"), F.lit(" Hz")),
        F.concat(F.lit("Duration: "), duration, F.lit(" s")),
        "",
        "Gains",
        "-----",
        gain("LUFS shared gain: ", "lufs_gain"),
        gain("Peak shared gain: ", "peak_gain"),
        gain("Total shared gain: ", "total_gain"),
        "",
        "Stereo",
        "------",
        gain("Correlation before: ", "correlation_before"),
        gain("Correlation after:  ", "correlation_after"),
        "",
        "Mid/Side",
        "--------",
        db("Mid RMS before:  ", "mid_before", " dBFS"),
        db("Mid RMS after:   ", "mid_after", " dBFS"),
        db("Side RMS before: ", "side_before", " dBFS"),
        db("Side RMS after:  ", "side_after", " dBFS"),
        db("Side/Mid before: ", "side_to_mid_before", " dB"),
        db("Side/Mid after:  ", "side_to_mid_after", " dB"),
        "",
        "LUFS",
        "----",
        loud("Stereo before: ", "lufs_before"),
        loud("Stereo after:  ", "lufs_after"),
        loud("Mid before:    ", "mid_lufs_before"),
        loud("Mid after:     ", "mid_lufs_after"),
        loud("Side before:   ", "side_lufs_before"),
        loud("Side after:    ", "side_lufs_after"),
        "Target LUFS:   -23.0",
        "",
        "Interpretace metrik",
        "-------------------",
        "LUFS: subjektivně vnímaná hlasitost; cíl sjednocuje celkovou úroveň nahrávek.",
        "Shared gain: jeden společný zesilovací koeficient pro L i R (zachová stereo poměr).",
        "Peak dBFS: nejvyšší okamžitá amplituda; blízko 0 dBFS hrozí clipping.",
        "RMS dBFS: průměrná energetická úroveň signálu (stabilnější než peak).",
        "Correlation L/R: podobnost kanálů; +1 téměř stejné, 0 nezávislé, -1 opačná fáze.",
        "Mid = (L+R)/2: společná složka, obvykle 'střed' scény.",
        "Side = (L-R)/2: rozdílová složka, nese stereo rozdíly mezi kanály.",
        "Side/Mid dB: relativní šířka sterea; vyšší hodnota znamená výraznější stereo separaci.",
        "Before/After: porovnání stavu před a po preprocessingu stejného signálu.",
    )
    return figures.select(*keys, F.array_join(lines, "\n").alias("report"))

"""Transcript sources: annotated XML, formal tab-separated text, word maps, language-model unigrams."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.functions import text as T
from voxframe.functions.lazy import pandas_udf
from voxframe.operators import segments as G

#: Python's line ends.
LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Encodings tried in turn.
ENCODINGS = ("utf-8", "cp1250", "iso8859-2")
# Speaker codes of formal transcripts.
SPEAKER_CODES = {"R": "interviewer", "M": "interviewee", "F": "interviewee"}


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """name (file name without folder and suffix), path, content of whole files."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("name"), "path", "content")


@pandas_udf("text string, encoding string")
def decoded(content: pd.Series) -> pd.DataFrame:
    """Bytes as text by the first encoding that reads them."""
    rows = []
    for raw in content:
        found = (None, None)
        for encoding in ENCODINGS:
            try:
                found = (bytes(raw or b"").decode(encoding), encoding)
                break
            except UnicodeDecodeError:
                continue
        rows.append(found)
    return pd.DataFrame(rows, columns=["text", "encoding"])


@pandas_udf("encoding string, confidence double")
def guessed_encoding(content: pd.Series) -> pd.DataFrame:
    """A plain guess: marks, valid UTF-8, then which of two legacy code pages has fewer control characters."""
    rows = []
    for raw in content:
        raw = bytes(raw or b"")
        if raw.startswith(b"\xef\xbb\xbf"):
            rows.append(("utf-8-sig", 1.0))
        elif raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
            rows.append(("utf-16", 1.0))
        elif raw.isascii():
            rows.append(("ascii", 1.0))
        else:
            try:
                raw.decode("utf-8")
                rows.append(("utf-8", 0.99))
            except UnicodeDecodeError:
                odd = sum(0x80 <= b < 0xA0 for b in raw)
                rows.append(("cp1250", 0.7) if odd else ("iso8859-2", 0.6))
    return pd.DataFrame(rows, columns=["encoding", "confidence"])


def decode_as(content, encoding: str):
    """Bytes as text by a named encoding, unreadable ones replaced."""

    @pandas_udf("string")
    def read(c: pd.Series) -> pd.Series:
        return c.map(lambda raw: None if raw is None else bytes(raw).decode(encoding, "replace"))

    return read(content)


def read_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return read_files(spark, paths).withColumn("_d", decoded("content")).select("name", "path", "_d.text", "_d.encoding")


def lines_of(files: DataFrame, *keep: str) -> DataFrame:
    """Lines of texts with their numbers from 1."""
    return files.select(*keep, F.posexplode(F.split("text", LINES)).alias("line_number", "line")).withColumn("line_number", F.col("line_number") + 1)


# ---- annotated XML -----------------------------------------------------------------------------------------------------

EVENTS = "turn int, piece int, seq int, start double, end double, speaker string, text string"


def turn_events(xml: str) -> Iterator[tuple[int, int, int, float, float, str, str]]:
    """Text events of a transcript's turns: (turn, piece, seq, start, end, speaker, text).

    A turn's pieces lie between its time marks. Text belongs to the turn's only speaker or, in turns of several, to
    "unknown" until a mark names one; a number past the last speaker means the last. Every time mark starts over.
    """
    root = ET.fromstring(re.sub(r"<!DOCTYPE.*?>", "", xml))
    names = {s.get("id"): s.get("name") for s in root.iter("Speaker")}
    seq = piece = 0
    for number, turn in enumerate(root.iter("Turn")):
        speakers = [names.get(i, i or "unknown") for i in (turn.get("speaker") or "").split()]
        alone = 0 if len(speakers) == 1 else None
        who, start, last = alone, float(turn.get("startTime")), float(turn.get("endTime"))
        said: list[tuple[str, str]] = []

        def say(text: str | None, who: int | None) -> None:
            if text:
                said.append(("unknown" if who is None or not speakers else speakers[min(who, len(speakers) - 1)], text))

        say(turn.text, who)
        ends: list[tuple[float, float, list]] = []
        for child in turn:
            if child.tag == "Sync":
                ends.append((start, float(child.get("time")), said))
                start, said, who = float(child.get("time")), [], alone
                say(child.tail, who)
            elif child.tag == "Who":
                who = max(0, int(child.get("nb", "1")) - 1)
                say(child.tail, who)
            else:
                say(child.text, who)
                say(child.tail, who)
        ends.append((start, last, said))
        for a, b, texts in ends:
            piece += 1
            for speaker, text in texts:
                seq += 1
                yield number, piece, seq, a, b, speaker, text


def annotated_events(files: DataFrame) -> DataFrame:
    """files (name, text) -> recording and text events. Mixed content has an order that Spark's XML reader loses."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, *e) for r, text in zip(batch["recording"], batch["text"]) if text for e in turn_events(text)]
            yield pd.DataFrame(rows, columns=["recording", "turn", "piece", "seq", "start", "end", "speaker", "text"])

    named = files.select(F.coalesce(T.recording_id(F.col("name")), F.lit("unknown")).alias("recording"), "text")
    return named.mapInPandas(run, f"recording string, {EVENTS}")


def annotated_segments(files: DataFrame) -> DataFrame:
    return G.make_segments(annotated_events(files), ["recording"])


# ---- formal transcripts ------------------------------------------------------------------------------------------------


def formal_rows(files: DataFrame) -> DataFrame:
    """files (name, text) -> recording, recording_key, speaker_code, speaker, part, start, seq (line number), text."""
    rows = lines_of(files, "name").withColumn("line", T.clean_text(F.col("line"))).where(F.col("line").contains("\t"))
    rows = rows.withColumn("id", T.clean_text(F.substring_index("line", "\t", 1))).withColumn("text", T.clean_for_asr(F.expr("substring(line, instr(line, '\t') + 1)")))
    form = r"^(\d+)_([MFR])_(\d+)_\((\d+\.\d+)\)$"
    rows = rows.where((F.col("text") != "") & F.col("id").rlike(form))
    part = lambda k: F.regexp_extract("id", form, k)
    codes = F.create_map(*[F.lit(x) for pair in SPEAKER_CODES.items() for x in pair])
    number = part(3).cast("int")
    return rows.select(
        "name", part(1).alias("recording"), F.concat(part(1), F.lit("_"), F.format_string("%03d", number)).alias("recording_key"), part(2).alias("speaker_code"),
        F.coalesce(F.try_element_at(codes, part(2)), F.lit("unknown")).alias("speaker"), number.alias("part"), part(4).cast("double").alias("start"), F.col("line_number").alias("seq"), "text",
    )


# ---- maps and models ---------------------------------------------------------------------------------------------------


def variant_map(files: DataFrame) -> DataFrame:
    """files (text) -> variant, canonical: of repeated variants the last line counts."""
    rows = lines_of(files).withColumn("line", T.clean_text(F.col("line"))).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    tabbed = F.col("line").contains("\t")
    parts = F.when(tabbed, F.split("line", r"\t+")).otherwise(T.tokens(F.col("line")))
    rows = rows.select("line_number", parts.alias("p"), tabbed.alias("tabbed")).where((F.col("tabbed") & (F.size("p") >= 2)) | (F.size("p") == 2))
    field = lambda k: F.lower(T.clean_text(F.col("p")[k]))
    rows = rows.select("line_number", field(0).alias("canonical"), field(1).alias("variant")).where("canonical <> '' AND variant <> ''")
    return rows.groupBy("variant").agg(F.max_by("canonical", "line_number").alias("canonical"))


def read_variant_map(spark: SparkSession, path: str) -> DataFrame:
    """A word map's file; one that is missing gives an empty map."""
    from pyspark.errors import AnalysisException

    try:
        files = read_files(spark, path)
    except AnalysisException:
        return spark.createDataFrame([], "variant string, canonical string")
    return variant_map(files.select(decode_ignoring("content").alias("text")))


@pandas_udf("string")
def decode_ignoring(content: pd.Series) -> pd.Series:
    return content.map(lambda raw: bytes(raw or b"").decode("utf-8", "ignore"))


def arpa_unigrams(files: DataFrame) -> DataFrame:
    """files (name, text) -> name, word: the sorted different words of the 1-gram section."""
    rows = lines_of(files, "name").withColumn("line", T.clean_text(F.col("line")))
    mark = F.when(F.col("line") == r"\1-grams:", 1).when(F.col("line").isin(r"\2-grams:", r"\end" + "\\"), 0)
    by = Window.partitionBy("name").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_m", mark).withColumn("inside", F.last("_m", True).over(by)).where("inside = 1 AND _m IS NULL")
    words = rows.select("name", T.tokens(F.col("line")).alias("p")).where(F.size("p") >= 2).select("name", F.col("p")[1].alias("word"))
    return words.where(~F.col("word").isin("<s>", "</s>", "<unk>")).distinct().orderBy("name", "word")


def ground_truth_sources(files: DataFrame, recordings: DataFrame) -> DataFrame:
    """recordings (recording) with the ground truths there are: their own file first, then the common formal one."""
    own = recordings.join(files, F.col("name") == F.concat("recording", F.lit("_gt_segments"))).select("recording", "path", F.lit(0).alias("priority"))
    shared = files.where("name = 'all_formal_gt_segments'").agg(F.sort_array(F.collect_set("path")).alias("p")).scalar()
    common = recordings.select("recording", F.explode(shared).alias("path"), F.lit(1).alias("priority"))
    return own.unionByName(common)


def missing_files(folder: str, names: list[str]) -> list[str]:
    """Which of a model folder's files are not there (driver only)."""
    import os

    return [n for n in names if not os.path.exists(os.path.join(folder, n))]

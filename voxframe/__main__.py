"""Jobs from the command line: python -m voxframe JOB ... --out FOLDER"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.plans import jobs
from voxframe.sources import audio, transcripts


def _write(texts: DataFrame, folder: str, key: str, column: str = "value") -> None:
    """One folder of text per key."""
    texts.select(F.col(key).alias("key"), F.col(column).alias("value")).write.mode("overwrite").partitionBy("key").text(folder)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="voxframe", description=__doc__)
    job = parser.add_subparsers(dest="job", required=True)
    for name, inputs in (("truth", "annotated transcripts"), ("formal", "formal transcripts"), ("evaluate", "recogniser output"), ("speakers", "recogniser output of two channels"), ("audio", "stereo WAV files"), ("cut", "WAV files"), ("encodings", "text files")):
        p = job.add_parser(name, help=inputs)
        p.add_argument("paths", nargs="+")
        p.add_argument("--out", required=True)
        if name in ("evaluate", "speakers"):
            p.add_argument("--truth", nargs="+", required=True)
            p.add_argument("--words", help="word map")
            p.add_argument("--numbers", help="number map")
        if name == "cut":
            p.add_argument("--start", type=float, required=True)
            p.add_argument("--end", type=float, required=True)
    o = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"voxframe {o.job}").getOrCreate()
    if o.job in ("truth", "formal"):
        segments, speakers = (jobs.annotated_truth if o.job == "truth" else jobs.formal_truth)(spark, o.paths)
        _write(segments, f"{o.out}/gt_segments", "recording")
        _write(speakers, f"{o.out}/gt_speakers", "recording")
    elif o.job in ("evaluate", "speakers"):
        maps = [transcripts.read_variant_map(spark, m) if m else None for m in (o.words, o.numbers)]
        if o.job == "evaluate":
            _write(jobs.text_reports(jobs.evaluate_texts(spark, o.paths, o.truth, *maps)), f"{o.out}/reports", "file", "report")
        else:
            rates, confidence, reports = jobs.evaluate_speakers(spark, o.paths, o.truth, *maps)
            rates.write.mode("overwrite").parquet(f"{o.out}/rates")
            confidence.write.mode("overwrite").parquet(f"{o.out}/mapping")
            _write(reports, f"{o.out}/reports", "name", "report")
    elif o.job == "audio":
        files, figures = jobs.process_audio(spark, o.paths)
        files.write.mode("overwrite").parquet(f"{o.out}/wav")
        figures.write.mode("overwrite").parquet(f"{o.out}/figures")
    elif o.job == "cut":
        audio.cut(transcripts.read_files(spark, o.paths), o.start, o.end).write.mode("overwrite").parquet(o.out)
    else:
        found = transcripts.read_files(spark, o.paths).select("path", transcripts.guessed_encoding("content").alias("e")).select("path", "e.*")
        found.write.mode("overwrite").json(o.out)


if __name__ == "__main__":
    main()

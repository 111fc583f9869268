from __future__ import annotations

import json
import sys
import wave

import numpy as np
import pytest
from pyspark import cloudpickle
from voxframe.operators import recognition
from voxframe.operators import segments as G
from voxframe.plans import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this module


def tone(hz, seconds, rate=8000):
    return 0.2 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def stereo_file(path, left, right, rate=8000):
    """Tones (start, seconds, hertz) per channel on twelve seconds of silence."""
    x = np.zeros((12 * rate, 2))
    for c, tones in enumerate((left, right)):
        for start, seconds, hz in tones:
            x[int(start * rate) : int(start * rate) + int(seconds * rate), c] += tone(hz, seconds, rate)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((x * 32767).astype("<i2").tobytes())


NAMES = {400: "Nízký tón zní", 800: "Vysoký hlas odpovídá", 600: "oba to slyší"}


def listener():
    """Names the tone of each stretch of sound over a tenth of a second, with where it lies in the chunk."""

    def hear(x, rate, **options):
        assert rate == 16000
        loud = np.abs(x).reshape(-1)[: len(x) // 160 * 160].reshape(-1, 160).max(1) > 0.05
        edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(int), [0]])))
        found = []
        for a, b in zip(edges[::2] * 160, edges[1::2] * 160):
            spectrum = np.abs(np.fft.rfft(x[a:b]))
            hz = round(spectrum.argmax() * rate / (b - a) / 200) * 200
            found.append({"start": a / rate, "end": b / rate, "text": NAMES[hz]})
        return found

    return hear


def words():
    hear = listener()
    return lambda x, rate, **options: " ".join(s["text"] for s in hear(x, rate))


def test_from_sound_to_json(spark, tmp_path):
    stereo_file(tmp_path / "7_1.wav", [(1.0, 1.5, 400), (9.0, 1.0, 600)], [(5.0, 2.0, 800), (9.05, 1.0, 600)])
    stereo_file(tmp_path / "8_1.wav", [], [])
    rows = {r.recording: r for r in jobs.recognise(spark, str(tmp_path), listener, "stub", "whisper").collect()}
    assert {r.file for r in rows.values()} == {"7_1_full_whisper", "8_1_full_whisper"}
    out = json.loads(rows["7_1"].value)
    got = [(s["id"], s["speaker"], s["text"]) for s in out["segments"]]
    assert got == [("asr_00001", "Speaker_L", NAMES[400]), ("asr_00002", "Speaker_R", NAMES[800]), ("asr_00003", "Speaker_L", NAMES[600])]
    for s, (a, b) in zip(out["segments"], ((1.0, 2.5), (5.0, 7.0), (9.0, 10.0))):
        assert abs(s["start"] - a) < 0.08 and abs(s["end"] - b) < 0.08  # pauses left out before the model are back
    assert out["speaker_R_full_transcription"] == f"{NAMES[800]} {NAMES[600]}" and out["full_transcription"].count(NAMES[600]) == 1
    meta = out["metadata"]
    assert meta["mode"] == "INDIVIDUAL_SPLIT" and meta["runtime_seconds"] > 0 and meta["run_started_utc"] < meta["run_finished_utc"]
    empty = json.loads(rows["8_1"].value)
    assert empty["segments"] == [] and empty["full_transcription"] == "" and empty["Speaker_L_full_transcription"] == ""


def test_chunks_and_ranges(spark, tmp_path):
    stereo_file(tmp_path / "7_1.wav", [(1.0, 1.5, 400), (9.0, 1.0, 600)], [(5.0, 2.0, 800)])
    plain = json.loads(jobs.recognise(spark, str(tmp_path), words, "stub", "interspeech", split=False, packed=False, chunk_seconds=4.0).first().value)
    assert [s["text"] for s in plain["segments"]] == [NAMES[400], NAMES[800], NAMES[600]] and plain["metadata"]["mode"] == "MIX"
    assert [round(s["start"]) for s in plain["segments"]] == [1, 5, 9]
    row = jobs.recognise(spark, str(tmp_path), listener, "stub", "whisper", start=4.0, end=8.0, chunk_seconds=1.5).first()
    cut = json.loads(row.value)  # a chunk's end cuts the tone in two, which are one segment again
    assert row.file == "7_1_range_whisper" and cut["metadata"]["has_custom_range"]
    assert cut["segments"] and all(s["speaker"] == "Speaker_R" and s["text"] == NAMES[800] for s in cut["segments"])
    assert abs(cut["segments"][0]["start"] - 5.0) < 0.08 and abs(cut["segments"][-1]["end"] - 7.0) < 0.08
    with pytest.raises(ValueError):
        jobs.recognise(spark, str(tmp_path), listener, "stub", "whisper", start=4.0, end=2.0)


def test_packed_times(spark):
    parts = spark.createDataFrame([("r", 0.0, 1.0, 10.0, 11.0), ("r", 1.1, 2.1, 20.0, 21.0)], "k string, packed_start double, packed_end double, original_start double, original_end double")
    rows = [("r", 1, -1.0, 0.5), ("r", 2, 0.4, 9.0), ("r", 3, 0.3, 0.3), ("r", 4, 0.2, 0.4), ("r", 5, 3.0, 4.0)]
    said = spark.createDataFrame(rows, "k string, id int, start double, end double").selectExpr("*", "0.9D AS chunk_start", "2.1D AS chunk_end", "100D AS base")
    got = {r.id: (round(r.start, 6), round(r.end, 6)) for r in G.packed_to_absolute(said, parts, ["k"]).collect()}
    assert got == {1: (110.9, 120.3), 2: (120.2, 121.0), 4: (120.0, 120.2)}


def test_ctc_paths():
    labels = ["_", "a", "b", "|"]
    logits = np.eye(4)[[1, 1, 0, 1, 3, 3, 2, 0]]
    assert recognition.greedy_ctc(logits, labels) == "aa b" and recognition.greedy_ctc(np.zeros((0, 4)), labels) == ""
    decode, used, message = recognition.ctc_decoder(labels, lambda: __import__("no_such_decoder"))
    assert decode(logits) == "aa b" and not used and "no_such_decoder" in message
    assert recognition.ctc_decoder(labels, lambda: lambda logits: "x")[:2][1] is True

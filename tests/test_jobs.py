from __future__ import annotations

import json
import wave

import numpy as np
from voxframe.plans import jobs
from voxframe.sources import audio, transcripts

from test_sources import XML


def write(path, data):
    path.write_text(data if isinstance(data, str) else json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_from_transcripts_to_reports(spark, tmp_path):
    trs = write(tmp_path / "12_1.trs", XML)
    segments, speakers = jobs.annotated_truth(spark, trs)
    truth = json.loads(segments.first().value)
    assert [s["id"] for s in truth["12_1"]] == ["seg_12_1_00001", "seg_12_1_00002", "seg_12_1_00003", "full_12_1_transcript"]
    assert truth["12_1"][-1]["text"] == "hello there again one two in tail"
    told = json.loads(speakers.first().value)
    assert {k: v["text"] for k, v in told["12_1"].items()} == {"interviewee": "two in tail", "interviewer": "hello there again one"}

    gt = write(tmp_path / "12_1_gt_segments.json", truth)
    formal = write(tmp_path / "all_formal_gt_segments.json", {"12_1": [{"id": "seg_12_1_00001", "start": 0.0, "end": 9.0, "text": "Hello again."}]})
    hyp = write(tmp_path / "12_1_MIX_full_whisper.json", {"metadata": {"mode": "MIX", "model": "large", "backend": "whisper", "runtime_seconds": 2.5}, "segments": [{"start": 0, "end": 5, "text": "Hello their again, one"}, {"start": 5, "end": 9, "text": "two in tales"}], "full_transcription": "x"})
    windowed = write(tmp_path / "12_1_MIX_range_x.json", {"metadata": {"start_seconds": 0.0, "end_seconds": 2.0}, "segments": [{"start": 0, "end": 2, "text": "hello there"}], "full_transcription": "hello there"})
    words = spark.createDataFrame([("their", "there")], "variant string, canonical string")
    numbers = spark.createDataFrame([("tales", "tail")], "variant string, canonical string")
    out = {(r.name, r.section): r for r in jobs.evaluate_texts(spark, [hyp, windowed], [gt, formal], words, numbers).collect()}
    best = out[("12_1_MIX_full_whisper", 0)]
    assert (best.hits, best["sub"], best.wer, best.words_replaced, best.numbers_replaced) == (7, 0, 0.0, 1, 1)
    assert best.source == "full_transcript (full_12_1_transcript)"
    assert out[("12_1_MIX_full_whisper", 1)].source == "full_transcript (fallback)"
    cut = out[("12_1_MIX_range_x", 0)]
    assert (cut.source, cut.hits, cut.wer, cut.numbers_replaced) == ("segments", 2, 0.0, None)
    reports = {r.file: r.report for r in jobs.text_reports(jobs.evaluate_texts(spark, hyp, [gt, formal], words, numbers)).collect()}
    lines = reports["12_1_MIX_full_whisper"].split("\n")
    assert lines[:2] == ["ASR Evaluation Report", "=" * 80] and lines.count("=" * 80) == 4
    assert "WER: 0.00 %" in lines and "Mode: MIX | Model: large | Backend: whisper" in lines
    assert "WordChanges: enabled=True | applied_to=hyp_substitutions | entries=1 | checked_sub_spans=1 | replaced_tokens=1" in lines
    assert "NumberChanges impact (WER): before=28.57 % | after=14.29 % | delta=-14.29 p.b." in lines


def test_speakers(spark, tmp_path):
    gt = write(tmp_path / "12_1_gt_speakers.json", {"12_1": {"interviewer": {"text": "short question"}, "interviewee": {"text": "a much longer answer to it"}}})
    hyp = write(tmp_path / "12_1_INDIVIDUAL_full_whisper.json", {"metadata": {"model": "large"}, "Speaker_L_full_transcription": "a much longer answer to that", "speaker_R_full_transcription": "short question", "segments": []})
    rates, confidence, reports = jobs.evaluate_speakers(spark, hyp, gt)
    got = {(r.mapping, r.role): (r.channel, round(r.wer, 4)) for r in rates.collect()}
    assert got[("length", "interviewer")] == ("speaker_r", 0.0) and got[("length", "interviewee")] == ("speaker_l", round(1 / 6, 4))
    c = confidence.first()
    assert c.winner == "length" and abs(c.length_wer - 1 / 8) < 1e-12 and c.delta_points > 0
    assert "WER (weighted by REF words): 12.50 %" in reports.first().report
    assert "GT role: interviewee | ASR source: speaker_l" in reports.first().report


def test_formal_truth(spark, tmp_path):
    path = write(tmp_path / "f.txt", "10_R_1_(0.50)\tFirst question\n10_M_1_(2.25)\tAn answer\n")
    segments, speakers = jobs.formal_truth(spark, path)
    assert [s["end"] for s in json.loads(segments.first().value)["10_001"]] == [2.25, 4.0]
    assert set(json.loads(speakers.first().value)["10_001"]) == {"interviewer", "interviewee"}


def test_hypotheses_are_assembled(spark):
    rows = [("r", "L", 0, 0.0, 1.0, "We went"), ("r", "L", 1, 1.2, 2.0, "to the river. Titulky vytvořil X"), ("r", "R", 0, 0.1, 1.9, "we went to the river"), ("r", "R", 1, 5.0, 6.0, "...")]
    frame = spark.createDataFrame(rows, "recording string, speaker string, seq int, start double, end double, text string")
    metadata = spark.createDataFrame([("r", "m")], "recording string, model string").selectExpr("recording", "struct(model) AS metadata")
    out = json.loads(jobs.assemble_hypotheses(frame, metadata, split=True).first().value)
    assert [(s["id"], s["speaker"], s["text"]) for s in out["segments"]] == [("asr_00001", "L", "We went to the river")]


def test_audio(spark, tmp_path):
    t = np.arange(16000) / 8000
    x = np.stack([0.1 * np.sin(2 * np.pi * 440 * t), 0.05 * np.sin(2 * np.pi * 660 * t)], 1)
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes((x * 32767).astype("<i2").tobytes())
    files, figures = jobs.process_audio(spark, str(tmp_path))
    assert sorted(r.name for r in files.collect()) == ["a_left", "a_mix", "a_right"]
    row = figures.first()
    assert abs(row.lufs_after + 23) < 0.2 and row.lufs_gain > 0 and "Duration: 2.00 s" in row.report
    assert audio.load(transcripts.read_files(spark, str(tmp_path))).first().rate == 8000

from __future__ import annotations

import json

import numpy as np
import pytest
from voxframe.operators import segments as G
from voxframe.operators import signal
from voxframe.sources import audio, hypotheses, transcripts

XML = """<!DOCTYPE Trans SYSTEM "trans.dtd">
<Trans><Speakers>
 <Speaker id="spk1" name="interviewer"/><Speaker id="spk2" name="interviewee"/><Speaker id="spk3" name="guest"/>
</Speakers><Episode><Section>
 <Turn speaker="spk1" startTime="0" endTime="4.5"><Sync time="0"/>hello [noise] there<Sync time="2.0"/>again</Turn>
 <Turn speaker="spk1 spk2" startTime="4.5" endTime="9"><Sync time="4.5"/>lost<Who nb="1"/>one<Who nb="2"/>two<Event desc="x">in</Event><Who nb="9"/>tail</Turn>
 <Turn startTime="9" endTime="10"><Sync time="9"/>nobody</Turn>
 <Turn speaker="spk3" startTime="10" endTime="11"><Sync time="12"/>late</Turn>
</Section></Episode></Trans>"""


def files(spark, *rows):
    return spark.createDataFrame(rows, "name string, text string")


def test_annotated_transcripts(spark):
    out = transcripts.annotated_segments(files(spark, ("10001_001_x", XML), ("none", None))).orderBy("seq").collect()
    assert [(r.recording, r.id, r.speakers, r.start, r.end, r.text, r.is_overlap) for r in out] == [
        ("10001_001", "seg_00001", ["interviewer"], 0.0, 2.0, "hello there", False),
        ("10001_001", "seg_00002", ["interviewer"], 2.0, 4.5, "again", False),
        ("10001_001", "seg_00003", ["interviewer", "interviewee", "unknown"], 4.5, 9.0, "one two in tail lost", True),
        ("10001_001", "seg_00004", ["unknown"], 9.0, 10.0, "nobody", False),
    ]
    assert out[2].text_by_speaker == {"interviewer": "one", "interviewee": "two in tail", "unknown": "lost"}


def test_eval_reference_of_annotated(spark):
    rows = transcripts.annotated_segments(files(spark, ("10001_001_x", XML)))
    out = G.eval_reference(rows, "recording").orderBy("seq").collect()
    assert [(r.id, r.text) for r in out] == [("seg_10001_001_00001", "hello there"), ("seg_10001_001_00002", "again"), ("seg_10001_001_00003", "one two in tail")]
    summary = {r.role: (r.text, r.start, r.end) for r in G.speaker_summary(G.eval_reference(rows, "recording"), "recording").collect()}
    assert summary == {"interviewer": ("hello there again one", 0.0, 9.0), "interviewee": ("two in tail", 0.0, 9.0)}


def test_formal_transcripts(spark):
    text = "10001_R_1_(0.50)\tFirst question\n\n10001_M_1_(2.25)\tAn [cough] answer\tmore\nno tab\n10001_X_1_(1.0)\tbad\n10001_F_2_(3)\tinteger\n10001_F_2_(3.0)\t[only]\n10001_F_2_(3.0)\tSecond part"
    rows = transcripts.formal_rows(files(spark, ("f", text))).orderBy("seq").collect()
    assert [(r.recording_key, r.speaker, r.start, r.seq, r.text) for r in rows] == [("10001_001", "interviewer", 0.5, 1, "First question"), ("10001_001", "interviewee", 2.25, 3, "An answer more"), ("10001_002", "interviewee", 3.0, 8, "Second part")]
    out = G.formal_segments(transcripts.formal_rows(files(spark, ("f", text))), "recording_key").orderBy("id").collect()
    assert [(r.id, r.start, r.end) for r in out] == [("seg_10001_001_00001", 0.5, 2.25), ("seg_10001_001_00002", 2.25, 4.0), ("seg_10001_002_00001", 3.0, 6.0)]


def test_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("příliš žluťoučký".encode())
    (tmp_path / "b.txt").write_bytes("příliš žluťoučký".encode("cp1250"))
    (tmp_path / "c.txt").write_bytes(b"plain")
    rows = {r.name: (r.text, r.encoding) for r in transcripts.read_text(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("příliš žluťoučký", "utf-8"), "b": ("příliš žluťoučký", "cp1250"), "c": ("plain", "utf-8")}
    found = transcripts.read_files(spark, str(tmp_path))
    guess = {r.name: r.e.encoding for r in found.select("name", transcripts.guessed_encoding("content").alias("e")).collect()}
    assert guess == {"a": "utf-8", "b": "cp1250", "c": "ascii"}
    assert {r.t for r in found.select(transcripts.decode_as("content", "ascii").alias("t")).collect() if r.t == "plain"} == {"plain"}


def test_variant_map(spark, tmp_path):
    text = "# comment\n\nadler\tAdleera\nAdler\t\tadlér\textra\nbyl byla\nthree words here\nbyt byla\n\tonly\n"
    assert {r.variant: r.canonical for r in transcripts.variant_map(files(spark, ("m", text)).select("text")).collect()} == {"adleera": "adler", "adlér": "adler", "byla": "byt"}
    (tmp_path / "m.txt").write_bytes("a\tb\n".encode() + b"\xffc\td\n")
    assert {r.variant: r.canonical for r in transcripts.read_variant_map(spark, str(tmp_path / "m.txt")).collect()} == {"b": "a", "d": "c"}
    assert transcripts.read_variant_map(spark, str(tmp_path / "absent")).count() == 0


def test_arpa(spark):
    text = "\\data\\\nngram 1=3\n\n\\1-grams:\n-1.2 word -0.3\n-1 <s>\n-2 also\n-2 also\n\n\\2-grams:\n-1 word also\n\\end\\\n"
    assert [r.word for r in transcripts.arpa_unigrams(files(spark, ("lm", text))).collect()] == ["also", "word"]


SEG = {"id": "seg_1", "start": 0.0, "end": 1.0, "text": "a"}


@pytest.mark.parametrize(
    ("data", "want"),
    [
        ([SEG, 3, {"text": "b"}], ["a", "b"]),
        ({"segments": [SEG, "x"]}, ["a"]),
        ({"data": [SEG]}, ["a"]),
        ({"10_1": [{"text": "late"}], "2_10": {"text": "mid", "start": 1}, "2": {"x": [{"text": "in"}], "y": {"text": "no"}, "z": {"text": "yes", "id": "q"}}, "other": [SEG]}, ["in", "yes", "mid", "late"]),
        ({"other": [SEG]}, []),
        ({}, []),
        ("text", []),
    ],
)
def test_json_shapes(spark, data, want):
    rows = hypotheses.flatten_segments(files(spark, ("f", json.dumps(data))), ["name"]).orderBy("seq").collect()
    assert [r.text for r in rows] == want


def test_hypotheses_and_channels(spark):
    text = json.dumps({"metadata": {"model": "Whisper large", "runtime_seconds": 1.5}, "segments": [{"speaker": "Speaker_L", "text": " a "}, {"speaker": "Speaker_R", "text": "b"}, {"speaker": "Speaker_L", "text": "c"}], "full_transcription": "a b c"})
    keyed = json.dumps({"Speaker_L_full_transcription": "x", "speaker_R_full_transcription": " y ", "segments": []})
    frame = files(spark, ("12_3_MIX_full_whisper", text), ("12_4_range", keyed))
    h = {r.name: r for r in hypotheses.hypotheses(frame).collect()}
    first = h["12_3_MIX_full_whisper"]
    assert first.recording == "12_3" and first.is_full and first.is_whisper and first.metadata.runtime_seconds == 1.5 and len(first.segments) == 3
    assert not h["12_4_range"].is_full and not h["12_4_range"].is_whisper
    got = {(r.name, r.channel): r.text for r in hypotheses.speaker_transcriptions(frame, ["name"]).collect()}
    assert got == {("12_3_MIX_full_whisper", "speaker_l"): "a c", ("12_3_MIX_full_whisper", "speaker_r"): "b", ("12_4_range", "speaker_l"): "x", ("12_4_range", "speaker_r"): "y"}


def test_roles_fall_back_to_the_first_whole_recording(spark):
    text = json.dumps({"1_1": {"interviewer": {"text": "q"}}, "1_2": {"interviewer": {"text": "q2"}, "interviewee": {"text": "a2"}}})
    texts = hypotheses.role_texts(files(spark, ("f", text)))
    wanted = spark.createDataFrame([("1_2",), ("9_9",)], "recording string")
    got = {(r.recording, r.role): (r.text, r.fallback_used) for r in hypotheses.roles_of(wanted, texts).collect()}
    assert got == {("1_2", "interviewer"): ("q2", False), ("1_2", "interviewee"): ("a2", False), ("9_9", "interviewer"): ("q2", True), ("9_9", "interviewee"): ("a2", True)}


def test_json_out(spark):
    rows = spark.createDataFrame([("é", None, 1)], "a string, b string, n int")
    assert json.loads(hypotheses.pretty_json(rows, ["a", "b", "n"]).first().value) == {"a": "é", "b": None, "n": 1}
    segments = spark.createDataFrame([("r", 1.0, 2.0, "b"), ("r", 0.0, 1.0, "a")], "recording string, start double, end double, text string")
    metadata = spark.createDataFrame([("r", "m")], "recording string, model string").selectExpr("recording", "struct(model) AS metadata")
    out = json.loads(hypotheses.hypothesis_json(segments, metadata, ["recording"]).first().value)
    assert out["full_transcription"] == "a b" and [s["text"] for s in out["segments"]] == ["a", "b"] and out["metadata"] == {"model": "m"}


def test_ground_truth_sources(spark):
    there = spark.createDataFrame([("1_1_gt_segments", "p1"), ("all_formal_gt_segments", "p2")], "name string, path string")
    out = transcripts.ground_truth_sources(there, spark.createDataFrame([("1_1",), ("1_2",)], "recording string"))
    assert sorted(tuple(r) for r in out.collect()) == [("1_1", "p1", 0), ("1_1", "p2", 1), ("1_2", "p2", 1)]
    assert transcripts.missing_files("/nowhere", ["a"]) == ["a"]


@pytest.mark.parametrize("width", [1, 2, 4])
def test_wav(spark, tmp_path, width):
    import wave

    x = np.round(np.sin(np.arange(1600) / 20) * 100).astype(int)
    raw = {1: (x + 128).astype("u1"), 2: x.astype("<i2"), 4: x.astype("<i4")}[width]
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(800)
        w.writeframes(np.stack([raw, raw[::-1]], 1).tobytes())
    found = transcripts.read_files(spark, str(tmp_path))
    scale = {1: 128, 2: 1 << 15, 4: 1 << 31}[width]
    row = audio.load(found, "stereo", 0.5, 1.0).first()
    assert row.rate == 800 and np.allclose(row.left, x[400:800] / scale, atol=1e-6) and np.allclose(row.right, x[::-1][400:800] / scale, atol=1e-6)
    assert np.allclose(audio.load(found, "mean").first().samples, (x + x[::-1]) / 2 / scale, atol=1e-6)
    cut = audio.cut(found, 0.5, 9.0).first()
    assert audio.read_wav(bytes(cut.content))[1].shape == (2, 1200)
    again = audio.to_wav(audio.load(found, "stereo"), ["left", "right"]).first()
    assert np.allclose(audio.read_wav(bytes(again.content))[1][0], x / scale, atol=1e-4)
    with pytest.raises(ValueError):
        audio.cut(found, 2.0, 1.0)


def test_loudness_of_a_known_tone():
    rate = 48000
    t = np.arange(rate * 2) / rate
    tone = np.sin(2 * np.pi * 997 * t)
    assert abs(signal.integrated_lufs([tone, tone], rate) - 0.0) < 0.1  # a full-scale stereo tone at 997 Hz
    assert abs(signal.integrated_lufs([tone], rate) + 3.01) < 0.1
    assert signal.integrated_lufs([tone[:100]], rate) is None and signal.integrated_lufs([tone * 0], rate) is None
    l, r, gain, peak = signal.level(tone * 0.01 + 0.2, tone * 0.01, rate)
    assert abs(signal.integrated_lufs([l, r], rate) + 23) < 0.1 and abs(l.mean()) < 1e-9 and peak == 1.0 and gain > 1


def test_filter_blocks_equal_the_recursion():
    r = np.random.default_rng(1)
    x = r.standard_normal(10000)
    for b, a in signal.k_weighting(16000):
        y = np.zeros(len(x))
        for n in range(len(x)):
            y[n] = sum(b[k] * x[n - k] for k in range(3) if n >= k) - sum(a[k] * y[n - k] for k in (1, 2) if n >= k)
        assert np.allclose(signal._biquad(x, b, a), y, atol=1e-6)


def test_stft_round_trip_and_crosstalk():
    r = np.random.default_rng(2)
    x = r.standard_normal(10000) * 0.1
    assert np.allclose(signal.istft(signal.stft(x), len(x)), x, atol=1e-9)
    quiet = x * 0.1
    a, b = signal.suppress_crosstalk(x, quiet)
    assert np.abs(a[3000:7000] - x[3000:7000]).max() < 1e-9 and np.abs(b[3000:7000]).max() < 1e-9
    assert len(signal.resample(np.arange(8, dtype=float), 8000)) == 16 and len(signal.resample(np.ones(1), 32000)) == 0

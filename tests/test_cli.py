from __future__ import annotations

import json

from test_sources import XML
from voxframe.__main__ import main


def test_truth_then_evaluation(spark, tmp_path):
    (tmp_path / "12_1.trs").write_text(XML, encoding="utf-8")
    main(["truth", str(tmp_path / "12_1.trs"), "--out", str(tmp_path / "out")])
    (part,) = (tmp_path / "out/gt_segments").rglob("part-*.txt")
    truth = json.loads(part.read_text(encoding="utf-8"))
    assert len(truth["12_1"]) == 4
    (tmp_path / "12_1_gt_segments.json").write_text(json.dumps(truth), encoding="utf-8")
    (tmp_path / "12_1_MIX_full_x.json").write_text(json.dumps({"metadata": {}, "segments": [{"start": 0, "end": 9, "text": "hello there again one two in"}], "full_transcription": "x"}), encoding="utf-8")
    main(["evaluate", str(tmp_path / "12_1_MIX_full_x.json"), "--truth", str(tmp_path / "12_1_gt_segments.json"), "--out", str(tmp_path / "out")])
    (part,) = (tmp_path / "out/reports").rglob("part-*.txt")
    assert "WER: 14.29 %" in part.read_text(encoding="utf-8")
    main(["encodings", str(tmp_path / "12_1.trs"), "--out", str(tmp_path / "enc")])
    assert "ascii" in "".join(p.read_text() for p in (tmp_path / "enc").rglob("*.json"))

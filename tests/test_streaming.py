from __future__ import annotations

import json

from voxframe.streaming import segments as S


def test_stream_of_segments(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [
        {"recording": "r", "seq": 0, "speaker": "a", "begun": "2024-01-01T00:00:01", "start": 0.0, "end": 2.0, "text": "Hello there"},
        {"recording": "r", "seq": 1, "speaker": "a", "begun": "2024-01-01T00:00:01", "start": 0.0, "end": 2.0, "text": "hello, THERE"},
        {"recording": "r", "seq": 2, "speaker": "b", "begun": "2024-01-01T00:06:00", "start": 9.0, "end": 10.5, "text": "yes"},
    ]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = S.read_segments(spark, str(tmp_path / "in"))
    query = S.first_heard(stream).writeStream.format("memory").queryName("heard").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert [r.seq for r in spark.sql("SELECT seq FROM heard ORDER BY seq").collect()] in ([0, 2], [1, 2])
    query = S.speech_time(stream).writeStream.outputMode("complete").format("memory").queryName("spoken").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.speaker, r.segments, r.words, r.seconds) for r in spark.sql("SELECT * FROM spoken").collect()}
    assert got == {("a", 2, 4, 4.0), ("b", 1, 1, 1.5)}

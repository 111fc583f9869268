"""The pipeline against the same steps in plain Python, on the small tables."""

from __future__ import annotations

import corpus_pipeline
from test_decontamination import words_of
from test_simhash import brute_copies
from voxframe.llm import quality as Q
from voxframe.llm._common import written


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, out = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = written(stage(spark, docs, small), name)
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        out[name] = (before, after)
    before, after = out["language"]
    assert len(after) >= 0.98 * len(before) and after.items() <= before.items()
    before, after = out["quality"]
    for d, t in before.items():
        n = Q.features(t)[1]
        assert d not in after or (n[0] >= 50 and 100 * n[4] <= 50 * n[0])
    before, after = out["near_duplicates"]
    ids = sorted(before)
    assert set(after) == {ids[k] for k in brute_copies([before[d] for d in ids])}
    before, after = out["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{small}/benchmark.parquet").collect():
        w = words_of(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)}
    for d, t in before.items():
        w = words_of(t)
        hit = any(tuple(w[i : i + k]) in windows for k in {len(x) for x in windows} for i in range(len(w) - k + 1))
        assert hit or after[d] == t
        if hit and d in after:
            assert len(after[d]) < len(t)
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(after)
    assert len({r.sequence_id for r in packed}) <= 1.05 * sum(r.length for r in packed) / 4096 + 1
    again = corpus_pipeline.run(spark, small)
    assert sorted(tuple(r)[:5] for r in again.collect()) == sorted(tuple(r)[:5] for r in packed)


def test_stages_stand_odd_documents(spark, small, documents, odd_texts):
    """Each stage on nulls, blanks, a very long text and repeated rows, with columns of clashing names; and on no rows."""
    for frame in (documents(odd_texts), documents([])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, small)
            rows = out.collect()
            assert name == "packing" or out.columns == frame.columns
            assert frame.isEmpty() == (not rows) or name in ("language", "quality")

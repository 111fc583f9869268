"""What keeps the evaluation's queries in proportion to their input."""

from __future__ import annotations

import random
import time

import pyarrow as pa
from voxframe.operators import alignment as A

LISTS = pa.list_(pa.string())


def made_pairs(n: int, size: int, letters: str, seed: int = 5) -> tuple[list, list]:
    """Random pairs, half of them alike, some of them null."""
    rnd = random.Random(seed)
    some = lambda: [rnd.choice(letters) for _ in range(rnd.randint(0, size))]
    ref = [some() if rnd.random() > 0.05 else None for _ in range(n)]
    return ref, [None if rnd.random() < 0.05 else [w for w in x or [] if rnd.random() > 0.2] if rnd.random() < 0.5 else some() for x in ref]


def seconds(f) -> float:
    began = time.process_time()
    f()
    return time.process_time() - began


def test_pairs_are_aligned_together(monkeypatch):
    """As one by one, whatever the sizes of matrices and parts, and in far less time."""
    for cells, words, n, size in ((A.CELLS, A.WORDS, 300, 30), (400, A.WORDS, 200, 20), (30, 50, 100, 12), (A.CELLS, A.WORDS, 0, 0)):
        monkeypatch.setattr(A, "CELLS", cells)
        monkeypatch.setattr(A, "WORDS", words)
        ref, hyp = made_pairs(n, size, "abcd")
        a, b = (pa.array([["x"], *x], LISTS).slice(1) for x in (ref, hyp))
        one = [A.align(x or [], y or []) for x, y in zip(ref, hyp)]
        together = A.align_words.__wrapped__(a, b).to_pylist()
        assert [[tuple(c.values()) for c in r.pop("chunks")] for r in together] == one
        assert [tuple(r.values()) for r in together] == [A.counts(c) for c in one]
        assert A.word_distance.__wrapped__(a, b).to_pylist() == [A.distance(*A._numbers(x, y)) for x, y in zip(ref, hyp)]
    monkeypatch.undo()
    ref, hyp = made_pairs(400, 160, "abcdefghijklmnopqrstuvwxyz")
    a, b = pa.array(ref, LISTS), pa.array(hyp, LISTS)
    alone = seconds(lambda: [A.align(x or [], y or []) for x, y in zip(ref, hyp)])
    assert seconds(lambda: A.align_words.__wrapped__(a, b)) < alone / 3


def test_trims_are_measured_together(monkeypatch):
    for cells, trims in ((A.CELLS, 6), (A.CELLS, 0), (60, 6)):
        monkeypatch.setattr(A, "CELLS", cells)
        ref, hyp = made_pairs(200, 14, "abcd")
        a, b = pa.array(ref, LISTS), pa.array(hyp, LISTS)
        want = [A.trimmed_distances(*A._numbers(x, y), trims) for x, y in zip(ref, hyp)]
        assert [tuple(r.values()) for r in A.trims_udf(trims).__wrapped__(a, b).to_pylist()] == want
    monkeypatch.undo()
    ref, hyp = made_pairs(400, 160, "abcdefghijklmnopqrstuvwxyz")
    a, b = pa.array(ref, LISTS), pa.array(hyp, LISTS)
    alone = seconds(lambda: [A.trimmed_distances(*A._numbers(x, y), 6) for x, y in zip(ref, hyp)])
    assert seconds(lambda: A.trims_udf(6).__wrapped__(a, b)) < alone / 3


def frame(spark, ref: list, hyp: list):
    return spark.createDataFrame(list(zip(range(len(ref)), ref, hyp)), "k int, ref array<string>, hyp array<string>")


def test_a_rows_own_errors_need_no_shuffle(spark):
    rows = A.with_alignment(frame(spark, *made_pairs(60, 60, "abc")))
    for k in (2, 20):
        own = A.with_own_top(rows, k)
        got = [(r.k, x.op, x.ref_text, x.hyp_text, x.cnt, i) for r in own.collect() for op in A.OPS for i, x in enumerate([x for x in r.top if x.op == op], 1)]
        want = A.top_errors(A.errors(rows, ["k"]), ["k"], k).select("k", "op", "ref_text", "hyp_text", "cnt", "rank").collect()
        assert sorted(got) == sorted(tuple(r) for r in want) and len(got) > 60
    from voxframe.plans import reports

    plan = reports.text_report(rows, ["k"])._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString() and plan.optimizedPlan().toString().count("ArrowEvalPython") == 2


def exchanges(plan) -> list[tuple[str, str]]:
    """Schema and partitioning of each shuffle below a plan's node."""
    own = [(plan.schema().simpleString(), plan.outputPartitioning().toString())] if plan.nodeName() == "Exchange" else []
    return own + [x for i in range(plan.children().size()) for x in exchanges(plan.children().apply(i))]


def test_texts_are_not_dealt_by_words(spark):
    """A map too large to broadcast, and a word that is heard in every text: texts stay dealt by their keys."""
    ref, hyp = made_pairs(80, 30, "abcdefgh")
    hyp = [x and ["zz" if i % 3 == 1 else w for i, w in enumerate(x)] for x in hyp]
    mapping = spark.createDataFrame([("a", "zz"), ("b", "c")], "variant string, canonical string")
    rows = A.with_alignment(frame(spark, ref, hyp)).localCheckpoint()
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "false")
        found = A.apply_variants(rows, mapping, ["k"])
        dealt = exchanges(found._jdf.queryExecution().executedPlan())
        assert dealt and all("array<" not in schema or by.startswith(("hashpartitioning(k#", "hashpartitioning(coalesce(k#")) for schema, by in dealt)
        got = {r.k: r for r in found.collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    form = {"a": "zz", "b": "c"}
    for r in rows.collect():
        want, said = list(r.hyp or []), 0
        for c in r.chunks:
            for i in range(c.re - c.rs) if c.op == "substitute" else ():
                x, y = r.ref[c.rs + i], r.hyp[c.hs + i]
                if form.get(x, x) == form.get(y, y):
                    want[c.hs + i], said = x, said + 1
        assert (got[r.k].corrected or [], got[r.k].tokens_replaced) == (want, said)
    assert len(got) == 80 and sum(r.tokens_replaced for r in got.values()) > 10

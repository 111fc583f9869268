from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from voxframe.operators import alignment as A
from voxframe.operators import evaluation as E

WORDS = st.lists(st.sampled_from("abcd"), max_size=12)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(WORDS, WORDS)
def test_alignment_is_least_and_whole(ref, hyp):
    chunks = A.align(ref, hyp)
    hits, sub, ins, dele, wer = A.counts(chunks)
    assert sub + ins + dele == plain_distance(ref, hyp)
    assert hits + sub + dele == len(ref) and hits + sub + ins == len(hyp)
    assert (wer is None) == (not ref) and (not ref or wer == (sub + ins + dele) / len(ref))
    i = j = 0
    for k, (op, rs, re_, hs, he) in enumerate(chunks):
        assert (rs, hs) == (i, j) and (k == 0 or chunks[k - 1][0] != op)
        same = ref[rs:re_] == hyp[hs:he]
        assert same if op == "equal" else True
        if op == "substitute":
            assert all(a != b for a, b in zip(ref[rs:re_], hyp[hs:he])) and re_ - rs == he - hs
        i, j = re_, he
    assert (i, j) == (len(ref), len(hyp))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 60))
def test_large_matrices_take_the_same_path(ref, hyp, cells):
    whole, limit = A.align(ref, hyp), A.CELLS
    A.CELLS = cells
    try:
        assert A.align(ref, hyp) == whole
    finally:
        A.CELLS = limit


@given(WORDS, WORDS, st.integers(0, 4))
def test_trimmed_distances(ref, hyp, trims):
    cut_ref, cut_hyp = A.trimmed_distances(*A._numbers(ref, hyp), trims)
    assert cut_ref == [plain_distance(ref[t:], hyp) for t in range(min(trims, len(ref)) + 1)]
    assert cut_hyp == [plain_distance(ref, hyp[t:]) for t in range(min(trims, len(hyp)) + 1)]


def test_an_alignment_is_planned_once(spark):
    rows = A.with_alignment(pairs_of(spark, (1, "a b c", "a x c")))
    top = A.top_errors(A.errors(rows, ["k"]), ["k"])
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_identity_and_symmetry():
    assert A.counts(A.align(list("abc"), list("abc")))[4] == 0
    x, y = (np.array(v) for v in ([1, 2, 3, 4], [2, 3, 5]))
    assert A.distance(x, y) == A.distance(y, x) == 2


def pairs_of(spark, *rows):
    return spark.createDataFrame([(k, r.split(), h.split()) for k, r, h in rows], "k int, ref array<string>, hyp array<string>")


def test_errors_top_and_examples(spark):
    rows = A.with_alignment(pairs_of(spark, (1, "a b c d e f", "a x c d f g"), (2, "", "new"), (3, "old", ""), (4, "", "")))
    got = {r.k: r for r in rows.collect()}
    assert (got[1].hits, got[1]["sub"], got[1]["ins"], got[1]["del"]) == (4, 1, 1, 1)
    assert got[2].wer is None and got[2]["ins"] == 1 and got[3].wer == 1 and got[4].wer is None
    top = A.top_errors(A.errors(rows, ["k"]), ["k"])
    assert {(r.k, r.op, r.ref_text, r.hyp_text, r.cnt) for r in top.collect()} == {(1, "substitute", "b", "x", 1), (1, "delete", "e", "", 1), (1, "insert", "", "g", 1), (2, "insert", "", "new", 1), (3, "delete", "old", "", 1)}
    lines = {r.k: r.examples for r in A.examples(top, ["k"]).collect()}
    assert lines[1] == ["SUB (1x): 'b' -> 'x'", "DEL (1x): 'e'", "INS (1x): 'g'"]


def test_top_breaks_ties_by_first_place(spark):
    rows = A.with_alignment(pairs_of(spark, (1, "a p b q c", "a x b y c")))
    top = A.top_errors(A.errors(rows, ["k"]), ["k"], k=1).collect()
    assert [(r.ref_text, r.hyp_text) for r in top] == [("p", "x")]


def test_corrections_are_taken_if_not_worse(spark):
    mapping = spark.createDataFrame([("adleera", "adler"), ("ádler", "adler")], "variant string, canonical string")
    pairs = pairs_of(spark, (1, "pan ádler byl", "pan adleera byl"), (2, "pan ádler", "pan nikdo"))
    out = {r.k: r for r in E.evaluate(pairs, ["k"], words=mapping).collect()}
    assert out[1].hyp == "pan ádler byl".split() and out[1].wer == 0 and out[1].words_replaced == 1 and out[1].words_used
    assert abs(out[1].words_before - 1 / 3) < 1e-12 and out[1].words_after == 0
    assert out[2].hyp == "pan nikdo".split() and out[2].words_checked == 1 and out[2].words_replaced == 0 and out[2].wer == 0.5


def test_offset_compensation(spark):
    rows = {r.k: r for r in E.offset_compensation(pairs_of(spark, (1, "x y a b c d e", "a b c d e"), (2, "a b c", "a b c"), (3, "a", "b"), (4, "a b c d", "z a b c d")), ["k"]).collect()}
    assert (rows[1].ref_trim, rows[1].hyp_trim, rows[1].use) == (2, 0, True)
    assert (rows[2].ref_trim, rows[2].hyp_trim, rows[2].use) == (0, 0, False)
    assert not rows[3].use and (rows[4].hyp_trim, rows[4].use) == (1, True)


def test_pooled(spark):
    rates = spark.createDataFrame([("r", 0.5, 10), ("r", 0.1, 30), ("s", 0.0, 0)], "k string, wer double, ref_words int")
    out = {r.k: r for r in E.pooled(rates, ["k"]).collect()}
    assert abs(out["r"].macro_wer - 0.3) < 1e-12 and abs(out["r"].weighted_wer - 0.2) < 1e-12 and out["s"].weighted_wer == 0

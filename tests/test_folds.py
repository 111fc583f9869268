"""Folds against a plain reading of their rules: whole lists, no streaming."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from voxframe.functions import plain
from voxframe.operators import folds


def seg(start, end, text, seq=0, **more):
    return {"start": start, "end": end, "text": text, "seq": seq, **more}


def run(machine, rows):
    return [(r["start"], r["end"], r["text"]) for r in [x for row in rows for x in machine.push(row)] + machine.close()]


def test_deduplicate():
    same = [seg(0.0, 2.0, "Hello there."), seg(0.5, 2.5, "hello THERE"), seg(3.0, 4.0, "hello there")]
    assert run(folds.Deduplicate(), same) == [(0.0, 2.0, "Hello there."), (3.0, 4.0, "hello there")]
    grows = [seg(0.0, 2.0, "hello"), seg(1.0, 3.0, "well hello there"), seg(1.2, 1.4, "there")]
    assert run(folds.Deduplicate(), grows) == [(0.0, 3.0, "well hello there")]
    touching = [seg(0.0, 1.0, "a b"), seg(1.0, 2.0, "a b"), seg(2.0, 3.0, "...")]
    assert run(folds.Deduplicate(), touching) == [(0.0, 1.0, "a b"), (1.0, 2.0, "a b")]
    late = [seg(0.0, 9.0, "a"), seg(1.5, 9.0, "a"), seg(1.6, 9.0, "a")]
    assert run(folds.Deduplicate(1.5), late) == [(0.0, 9.0, "a"), (1.6, 9.0, "a")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 30), st.sampled_from(["a", "a b", "b", "c a b", "B.", "..", "d"])), max_size=25))
def test_deduplicate_streams_like_a_whole_list(items):
    rows = sorted((seg(a / 10, (a + n) / 10, t) for a, n, t in items), key=lambda r: (r["start"], r["end"]))
    kept = []
    for row in rows:
        form = plain.dedup_form(row["text"])
        if not form:
            continue
        for old in reversed(kept):
            if row["start"] - old["start"] > 1.5:
                kept.append(dict(row))
                break
            apart = row["end"] <= old["start"] or row["start"] >= old["end"]
            if not apart and form in plain.dedup_form(old["text"]):
                break
            if not apart and plain.dedup_form(old["text"]) in form:
                old.update(start=min(old["start"], row["start"]), end=max(old["end"], row["end"]), text=row["text"])
                break
        else:
            kept.append(dict(row))
    assert run(folds.Deduplicate(), rows) == [(r["start"], r["end"], r["text"]) for r in kept]


def test_merge_overlapping():
    assert run(folds.MergeOverlapping(), [seg(0.0, 2.0, "one two three"), seg(1.5, 3.0, "Two, three four")]) == [(0.0, 3.0, "one two three four")]
    assert run(folds.MergeOverlapping(), [seg(0.0, 2.0, "one two three"), seg(1.0, 3.0, "two")]) == [(0.0, 3.0, "one two three")]
    assert run(folds.MergeOverlapping(), [seg(0.0, 2.0, "two"), seg(1.0, 1.5, "one two three")]) == [(0.0, 2.0, "one two three")]
    assert run(folds.MergeOverlapping(), [seg(0.0, 2.0, "x y"), seg(1.0, 2.0, "p q")]) == [(0.0, 2.0, "x y"), (2.001, 2.002, "p q")]
    assert run(folds.MergeOverlapping(), [seg(0.0, 2.0, "x"), seg(2.5, 3.0, "x")]) == [(0.0, 2.0, "x"), (2.5, 3.0, "x")]


def test_strip_boundaries():
    assert run(folds.StripBoundary(), [seg(0.0, 1.0, "we spell A-B-C"), seg(1.0, 2.0, "ABC, and on")])[1][2] == "and on"
    assert run(folds.StripBoundary(), [seg(0.0, 1.0, "we spell A-B-C"), seg(1.0, 2.0, "ABC")])[1][2] == "ABC"
    assert run(folds.StripBoundary(), [seg(0.0, 1.0, "nothing"), seg(1.0, 2.0, "ABC and on")])[1][2] == "ABC and on"


def test_merge_adjacent():
    one = lambda a, b, gap=0.5: run(folds.MergeAdjacent(), [seg(0.0, 1.0, a), seg(1.0 + gap, 3.0, b)])
    assert one("We went", "to the river.") == [(0.0, 3.0, "We went to the river.")]
    assert len(one("We went", "to the river.", gap=1.3)) == 2
    assert len(one("Where did you go?", "We went down to the river.")) == 2
    assert one("Where did you go?", "To the river.") == [(0.0, 3.0, "Where did you go? To the river.")]
    assert len(one("We went.", "Then we all came back again.")) == 2
    assert one("down to the river", "the river we went") == [(0.0, 3.0, "down to the river we went")]
    assert len(one(" ".join(["w"] * 33), "v v v v")) == 2
    assert one("he said go now please", "go now then") == [(0.0, 3.0, "he said go now then")]
    assert one("say hello there", "hello") == [(0.0, 3.0, "say hello there")]


def test_trim_boundaries():
    out = run(folds.TrimBoundary(), [seg(0, 1, "a b c"), seg(1, 2, "B, c!"), seg(2, 3, "c d"), seg(3, 4, "e")])
    assert [t for _, _, t in out] == ["a b c", "d", "e"]


def test_cross_channel_chain():
    rows = [seg(0.0, 1.0, "x", speaker="L"), seg(0.5, 1.5, "x", speaker="R"), seg(1.2, 2.0, "x", speaker="L")]
    out = run(folds.CrossChannel(), rows)
    assert [r[0] for r in out] == [0.0, 1.2]  # the second is dropped, and so cannot drop the third
    assert len(run(folds.CrossChannel(), [seg(0.0, 1.0, "x", speaker="L"), seg(1.0, 2.0, "x", speaker="R")])) == 1
    assert len(run(folds.CrossChannel(), [seg(0.0, 5.0, "x", speaker="L"), seg(1.1, 2.0, "x", speaker="R")])) == 2


def test_pack_windows():
    pack = lambda ws, s=10.0, d=100.0: [(r["start"], r["end"]) for r in (lambda m: [x for w in ws for x in m.push({"start": w[0], "end": w[1], "duration": d})] + m.close())(folds.PackWindows(s))]
    assert pack([(0.0, 4.0), (5.0, 9.0), (9.5, 12.0)]) == [(0.0, 9.0), (9.5, 12.0)]
    assert pack([(0.0, 25.0)]) == [(0.0, 10.0), (10.0, 20.0), (20.0, 25.0)]
    assert pack([(-3.0, 2.0), (99.0, 200.0), (150.0, 160.0)]) == [(0.0, 2.0), (99.0, 100.0)]
    assert pack([]) == []


@pytest.mark.parametrize("partitions", [1, 7])
def test_one_pass_equals_the_steps(spark, partitions):
    r = random.Random(2)
    words = "we went down to the river A-B-C ABC and then?".split()
    rows = [(str(g), i, i * 0.7, i * 0.7 + r.random() * 2, " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for g in range(9) for i in range(40)]
    frame = spark.createDataFrame(rows, "recording string, seq int, start double, end double, text string").repartition(partitions)
    stepwise = folds.deduplicate(frame, ["recording"])
    stepwise = folds.merge_overlapping(stepwise, ["recording"])
    # later steps keep the order the first ones gave
    whole = folds.postprocess(frame, ["recording"])
    plain_rows = []
    for g in range(9):
        own = sorted(({"recording": str(g), "seq": s, "start": a, "end": b, "text": t} for q, s, a, b, t in rows if q == str(g)), key=lambda x: (x["start"], x["end"], x["seq"]))
        for machine in (folds.Deduplicate(), folds.MergeOverlapping(), folds.StripBoundary(), folds.MergeAdjacent()):
            own = [x for row in own for x in machine.push(row)] + machine.close()
        plain_rows += [tuple(x[c] for c in frame.columns) for x in own]
    assert sorted(map(tuple, whole.collect())) == sorted(plain_rows)
    assert stepwise.count() >= whole.count()
    assert folds.postprocess(frame.limit(0), ["recording"]).count() == 0

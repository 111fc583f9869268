"""Registered queries work on whole inputs: all turns, all words, all frames."""

from __future__ import annotations

from voxframe.functions import plain
from voxframe.plans import catalog
from voxframe.plans import inputs as I


def test_folds_are_given_whole_turns(spark, small):
    turns = [(r.recording, " ".join(r.text.split())) for r in I.segments(spark, small).collect()]
    assert max(len(t.split()) for _, t in turns) > 20
    kept = {}
    for r in catalog.QUERIES["dedup_segments"](spark, small).collect():
        kept.setdefault(r.recording, []).append(plain.dedup_form(r.text))
    assert all(any(plain.dedup_form(t) in k for k in kept[rec]) for rec, t in turns if plain.dedup_form(t))
    for name in ("postprocess", "merge_overlaps", "merge_adjacent", "strip_boundaries"):
        ends = {}
        for r in catalog.QUERIES[name](spark, small).collect():
            ends.setdefault(r.recording, []).append(r.text)
        for rec, t in turns:  # the end of a turn is there, whatever was merged at its start
            assert not t or any(" ".join(t.split()[-3:]).lower() in x.lower() for x in ends[rec]), name


def test_every_turn_has_its_section(spark, small):
    turns = {}
    for r in I.segments(spark, small).collect():
        turns[r.recording] = turns.get(r.recording, 0) + 1
    assert max(turns.values()) > 2
    assert {r.recording: r.report.count("WER: ") for r in catalog.QUERIES["report_text"](spark, small).collect()} == turns


def test_signal_reports_cover_all_frames(spark, small):
    frames = len({r.frame for r in I.stereo(spark, small).collect()})
    reports = [r.report for r in catalog.QUERIES["signal_report"](spark, small).collect()]
    seconds = sum(float(line.split()[1]) for r in reports for line in r.split("\n") if line.startswith("Duration: "))
    assert abs(seconds - frames * 64 / 800) < 0.01 * len(reports)


def test_offset_compensation_of_short_turns(spark, small):
    """Brute force over all trims, short turns among them."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    got = {(r.recording, r.seq): r for r in catalog.QUERIES["offset_compensation"](spark, small).collect()}
    turns = {(r.recording, r.seq): r for r in I.word_pairs(spark, small).collect()}
    assert got.keys() == turns.keys() and any(len(t.ref) <= 6 for t in turns.values())
    for key, t in turns.items():
        if len(t.ref) > 30:
            continue
        ref, hyp, tries = t.ref[3 if key[1] % 3 == 1 else 0 :], t.hyp[2 if key[1] % 3 == 0 else 0 :], []
        for k, (a, b) in enumerate([(0, 0)] + [x for t in range(1, 7) for x in ((t, 0), (0, t))]):
            x, y = ref[a:], hyp[b:]
            if k and not (x and y):
                continue
            prefix = sum(p == q for p, q in zip(x[:12], y[:12]))
            tries.append((round(distance(x, y) / len(x), 12) if x else 0.0, -prefix, k, a, b))
        best, r = min(tries), got[key]
        assert (round(r.comp_wer, 12), -r.comp_prefix, r.ref_trim, r.hyp_trim) == (*best[:2], *best[3:]), key
        assert round(r.base_wer, 12) == tries[0][0] and r.base_prefix == -tries[0][1]

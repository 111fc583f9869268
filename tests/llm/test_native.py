"""Perspective rotation, license scans and sharding: no Python on the executors."""

from __future__ import annotations

import random
import zlib
from collections import Counter

from voxframe.llm import chat, licenses, sharding

# ---- chat --------------------------------------------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string, start long, segment string"


def brute_rotation(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "unknown", x or "", t) for c, t, r, x in rows if c == conv))
        for who in {t[2] for t in turns} - {"system"}:
            at = 0
            for _, _, role, text, turn in turns:
                head = "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                segment = f"{head}{text}<|end|>\n"
                mask = (at + len(head), at + len(segment)) if role == who else (None, None)
                out.append((conv, who, turn, role, segment, at, *mask))
                at += len(segment)
    return out


def test_rotation_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(c, r.choice([0, 1, 2, 300, 301, 5000, None]), r.choice(["ann", "bob", "system", "cy", None]), r.choice([None, "", "hi", "Grüße\n😀 x"])) for c in (1, 2, None) for _ in range(25)]
    rows += [(4, 0, "system", "only")] + [(5, i, f"p{i % 3}", "x") for i in range(700)] + [(6, 1, "ann", "same")] * 3
    frame = spark.createDataFrame([(*x, None, "clash") for x in rows], CONVERSATIONS)
    got = [tuple(x) for x in chat.rotate(frame).collect()]
    assert Counter(got) == Counter(brute_rotation(rows))
    whole = {(x.conv_id, x.perspective): x for x in chat.dialogues(chat.rotate(frame)).collect()}
    d = whole[(5, "p1")]
    assert all(d.text[m["first"] : m["end"]] == "x<|end|>\n" for m in d.masks) and len(d.masks) == 233
    assert chat.rotate(frame.limit(0)).count() == 0


def test_no_python_in_native_plans(spark, documents, small):
    from voxframe.llm.queries import op2_chat, op3_licenses, op8_sharding

    for query in (op2_chat, op3_licenses, op8_sharding):
        plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# ---- licences ----------------------------------------------------------------------------------------------------------


def brute_scan(rows):
    model, out = licenses.trained(), []
    for doc, text in rows:
        for k, line in enumerate(text.split("\n") if text is not None else []):
            words = licenses.words_of(line)
            scores = model.scores(words)
            unknown = scores.pop("unknown")
            best = max(scores.values())
            family = min(c for c, v in scores.items() if v == best) if best > unknown else "unknown"
            pairs = {f"{a} {b}" for a, b in zip(words, words[1:])}
            cover = 0
            for notice in licenses.NOTICES.get(family, []):
                w = licenses.words_of(notice)
                own = {f"{a} {b}" for a, b in zip(w, w[1:])}
                cover = max(cover, len(own & pairs) * 100 // len(own))
            if family != "unknown" or set(words) & set(licenses.NAMES):
                out.append((doc, k, family, best - unknown, cover, cover >= licenses.CONFIRM))
    return Counter(out)


def test_scan_equals_brute_force(spark, documents, odd_texts):
    r = random.Random(1)
    notices = [n for ns in licenses.NOTICES.values() for n in ns]
    rows = [(100 + i, "\n".join(r.choice([r.choice(notices), "some other words", "", r.choice(licenses.NEGATIVES), "License Unknown to us", "the of and is to in under"]) for _ in range(r.randint(1, 6)))) for i in range(120)]
    rows += [(d, t) for d, t in odd_texts]
    got = Counter(tuple(x) for x in licenses.scan(documents(rows)).collect())
    assert got == brute_scan(rows)
    assert licenses.scan(documents([])).count() == 0


def test_families_are_told():
    model = licenses.trained()
    for family, notices in licenses.NOTICES.items():
        for notice in notices:
            scores = model.scores(licenses.words_of(notice))
            assert max(scores, key=scores.get) == family, notice
    wrong = sum(max((s := model.scores(licenses.words_of(t))), key=s.get) != "unknown" for t in licenses.NEGATIVES)
    assert wrong == 0


def test_without_an_anchor_nothing_is_a_licence():
    model = licenses.trained()
    free = {g: w for g, w in model.weights.items() if not set(g.split()) & set(model.anchors)}
    for family in licenses.NOTICES:
        most = sum(max(0, w.get(family, 0) - w.get("unknown", 0)) for w in free.values())
        assert model.bias[family] + most <= model.bias["unknown"]


# ---- sharding ----------------------------------------------------------------------------------------------------------


def test_sizes_slots_and_laws(spark, documents, odd_texts):
    rows = [(1000 + i, f"text {i}") for i in range(4000)] + odd_texts
    out = sharding.assign(documents(rows), sharding.layout(16), sharding.layout(17), blocks=64).collect()
    assert len(out) == len(rows)
    sizes = Counter((r.doc_id, r.size, r.text_crc32) for r in out)
    assert sizes == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    counts = Counter(r.shard for r in out)
    assert set(counts) == set(range(16)) and max(counts.values()) < 1.35 * min(counts.values())
    for s, n in counts.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    moved = {r.grown_shard for r in out if r.grown_shard != r.shard}
    assert moved == {16} and sum(r.grown_shard == 16 for r in out) < 2 * len(out) / 17
    of = {}
    assert all(of.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard) and r.law == "key" for r in out)
    assert sharding.assign(documents([]), sharding.layout(16), sharding.layout(17)).count() == 0


def test_key_law_holds_at_every_size(spark):
    from pyspark.sql import functions as F

    ids = spark.range(3000)
    shards = ids.select(*[sharding.shard_of(F.col("id"), sharding.layout(n)).alias(f"s{n}") for n in range(16, 20)]).collect()
    for n in range(16, 19):
        assert all(r[f"s{n + 1}"] in (r[f"s{n}"], n) for r in shards)


def test_moves_stay_inside_changed_subtrees(spark):
    from pyspark.sql import functions as F

    ids = spark.range(6000)
    base, heavier, gone = sharding.layout(16), sharding.layout(16, weights={0: 2.0}), sharding.layout(16, weights={0: 0.0})
    rows = ids.select(*[sharding.shard_of(F.col("id"), t).alias(k) for k, t in (("a", base), ("b", heavier), ("c", gone))]).collect()
    region, rack = (lambda s: s // 8), (lambda s: s // 4)
    for r in rows:
        if r.a != r.b:  # only into the heavier region; inside it only into the heavier rack; inside that into the shard
            assert region(r.b) == 0 and (region(r.a) != 0 or rack(r.b) == 0) and (rack(r.a) != 0 or r.b == 0)
        if r.a != r.c:  # out of what got lighter
            assert region(r.a) == 0 and (region(r.c) == 1 or rack(r.a) == 0)
        assert r.c != 0

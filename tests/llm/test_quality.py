from __future__ import annotations

import random

from voxframe.llm import quality as Q


def brute_counts(text):
    spaces = " \t\n\x0b\x0c\r"
    split = lambda s: [w for w in "".join(" " if c in spaces else c for c in s).split(" ") if w]
    words = split(text or "")
    lines = [x for x in (text or "").split("\n") if split(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_counts_equal_brute_force(odd_texts):
    r = random.Random(2)
    texts = [t for _, t in odd_texts if t is None or len(t) < 1000]
    texts += ["".join(r.choice("ab# \n\x0b\x85é|") for _ in range(r.randint(0, 60))) for _ in range(300)]
    for t in texts:
        assert Q.features(t)[1] == brute_counts(t), t


def _corpus():
    r = random.Random(4)
    good = [" ".join(r.choice("the of and river house walk over stone light tree".split()) for _ in range(70)) for _ in range(120)]
    bad = [" ".join(r.choice("buy cheap pills now click".split()) + r.choice(["!!!", "###", ""]) for _ in range(70)) for _ in range(40)]
    return good, bad


def test_judges_by_the_ratio(spark, documents, odd_texts):
    good, bad = _corpus()
    docs = [(i, t) for i, t in enumerate(good)] + [(1000 + i, t) for i, t in enumerate(bad)] + [(5000 + (d or 0), t) for d, t in odd_texts]
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(1000 + i, 0, 0) for i in range(0, 40, 2)] + [(1, None, None), (None, 1, 0), (0, 1, 0), (99999, 1, 0)]
    frame = documents(docs)
    model = Q.fit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r.doc_id: r for r in Q.judge(frame, model).collect()}
    assert all(out[i].kept for i in range(120) if not out[i].base_failed)
    assert not any(out[1000 + i].kept for i in range(40))
    for d, t in docs:
        n = brute_counts(t) if t is None or len(t) < 1000 else None
        if n:
            assert tuple(out[d])[1:6] == n and out[d].base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert abs(out[d].score - model.score((t or "").encode().split())) < 1e-12
    kept = Q.keep(frame, model)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if out[d].kept)


def test_without_labels_the_base_rules_decide(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents([(1, " ".join(f"w{i}" for i in range(60))), (2, "short"), (3, None)])
    out = {r.doc_id: r.kept for r in Q.judge(docs, Q.fit(docs, none)).collect()}
    assert out == {1: True, 2: False, 3: False}
    assert Q.judge(documents([]), Q.fit(documents([]), none)).count() == 0


def test_cut():
    assert Q.cut_at([], [1.0], 0.1) is None and Q.cut_at([1.0], [], 0.1) is None
    assert Q.cut_at([1.0, 2.0], [0.0, 0.5], 0.0) == 0.75
    assert Q.cut_at([1.0, 2.0], [3.0], 0.0) is None


def test_query_follows_the_labels(spark, small):
    from voxframe.llm.queries import op6_quality

    out = {r.doc_id: r for r in op6_quality(spark, small).collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    good = [out[r.doc_id] for r in labels if r.quality == 1 and not out[r.doc_id].base_failed]
    bad = [out[r.doc_id] for r in labels if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.2 * len(bad)
    for r in spark.read.parquet(f"{small}/documents.parquet").collect()[:60]:
        assert tuple(out[r.doc_id])[1:6] == brute_counts(r.text)


def test_every_label_counts(spark, documents):
    """More labels than any sample would hold: target and threshold equal those made in plain Python of all labelled documents."""
    import numpy as np
    from pyspark.sql import functions as F

    r = random.Random(6)
    n = 25_000
    bag = [f"w{k}" for k in range(40)]
    texts = {i: " ".join(r.choices(bag, weights=range(1, 41) if i % 7 else range(40, 0, -1), k=55)) for i in range(n)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(None, texts[1]), (n, None)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    half = {x.id: x.h for x in spark.range(n).select("id", F.xxhash64("id").bitwiseAND(F.lit(1)).alias("h")).collect()}
    raw, target = np.zeros(Q.BUCKETS), np.zeros(Q.BUCKETS)
    for i, t in [*texts.items(), (None, texts[1])]:
        got = Q.buckets(t.encode().split())
        np.add.at(raw, got, 1)
        if i is not None and i % 7 and not half[i]:
            np.add.at(target, got, 1)
    p = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    q = (target + Q.PRIOR * len(p) * p) / (target.sum() + Q.PRIOR * len(p))
    plain = Q.Model(np.log(q) - np.log(p), None)
    held = {k: [plain.score(t.encode().split()) for i, t in texts.items() if half[i] and (i % 7 > 0) == k and not Q.verdict(i, t, plain)[6]] for k in (True, False)}
    for bits in (Q.SIEVE_BITS, 128):  # a bitmap that lets all through changes nothing
        model = Q.fit(docs, labels, bits=bits)
        assert np.array_equal(model.ratio, plain.ratio)
        assert model.threshold == Q.cut_at(held[True], held[False], Q.MAX_LOSS)


def test_cut_of_many_scores(spark):
    r = random.Random(8)
    for n, loss in ((1, 0.0), (7, 0.5), (3000, 0.01), (3000, 0.3)):
        good = [r.choice([r.gauss(1, 1), 0.25]) for _ in range(n)]
        bad = [r.gauss(0, 1) for _ in range(n)]
        scored = spark.createDataFrame([(1, x) for x in good] + [(0, x) for x in bad], "kind int, score double")
        assert Q.cut_of(scored, loss) == Q.cut_at(good, bad, loss)
        assert Q.nth_least(scored.where("kind = 1"), n // 2, bins=3) == sorted(good)[n // 2]
    assert Q.cut_of(scored.where("kind = 0"), 0.1) is None and Q.cut_of(scored.where("kind = 1"), 0.1) is None

from __future__ import annotations

import random

import pytest
import xxhash
from voxframe.llm import simhash


def brute_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w]


def brute_fingerprint(text):
    words = brute_words(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps: dict[int, int]) -> dict[int, int]:
    label = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_fingerprint_equals_brute_force(odd_texts):
    for _, text in odd_texts:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("shard", [2048, 3])
def test_links_and_components_equal_brute_force(spark, shard):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = {0: 0, 1: 3, 2: 15}
    for i in range(3, 160):  # chains and dense balls, so that shards are hot for a limit of 3
        x = r.choice(base)
        for _ in range(r.randint(0, 4)):
            x ^= 1 << r.randint(0, 63)
        fps[i] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = spark.createDataFrame([(signed(x),) for x in set(fps.values())], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(distinct, shard=shard)).collect()}
    want = brute_components(fps)
    groups = {}
    for d, x in fps.items():
        groups.setdefault(found.get(signed(x), signed(x)), set()).add(d)
    expected = {}
    for d, c in want.items():
        expected.setdefault(c, set()).add(d)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_bk_tree_finds_all_within():
    r = random.Random(1)
    xs = list({r.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for x in xs:
        tree.add(x)
        tree.add(x)
    for q in xs[:50]:
        assert sorted(tree.within(q, 2)) == sorted(x for x in xs if (x ^ q).bit_count() <= 2)
    assert simhash.BKTree().within(5, 2) == []


def test_odd_documents(documents, odd_texts):
    out = simhash.near_duplicates(documents(odd_texts)).collect()
    assert len(out) == len(odd_texts)
    by = {r.doc_id: r for r in out}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1
    assert by[6].component_id == 4 and by[8].component_id == 7
    for d, text in odd_texts:
        if d is not None:
            assert by[d].fingerprint == f"{brute_fingerprint(text):016x}"
    assert simhash.near_duplicates(documents([])).count() == 0


def brute_shingles(text):
    words = brute_words(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_copies(texts: list) -> list[int]:
    """Of each text the first one that it is linked to by similarities of 0.8 or more."""
    sets, label = [brute_shingles(t) for t in texts], list(range(len(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if (not sets[i] and not sets[j]) or (sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            least = min(label[i], label[j])
            if label[i] != least or label[j] != least:
                label[i] = label[j] = least
                changed = True
    return label


@pytest.mark.parametrize("cell", [8192, 4])
def test_keep_one_equals_brute_force(documents, odd_texts, cell):
    """One row of each group, of groups with chains of changes, of equal rows, of unlinked texts that share a doc_id."""
    r = random.Random(8)
    texts = list(odd_texts)
    for k in range(12):
        words = [f"w{r.randint(0, 400)}" for _ in range(r.choice([8, 60, 200]))]
        for j in range(r.choice([1, 3, 12])):
            texts.append((100 + k // 2, " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // 70)):
                words[r.randrange(len(words))] = f"x{k} {j}"
    label = brute_copies([t for _, t in texts])
    want = {}
    for (d, t), g in zip(texts, label):
        want.setdefault(g, []).append((d is None, d or 0))
    frame = documents(texts)
    kept = simhash.keep_one(frame, cell=cell)
    assert kept.columns == frame.columns
    got = sorted((x.doc_id is None, x.doc_id or 0) for x in kept.collect())
    assert got == sorted(min(g) for g in want.values())


def test_keep_one_by_rows(documents, spark):
    """Different texts under one doc_id stay; helper columns do not touch columns of their names."""
    a, b, c = (" ".join(f"{p}{i}" for i in range(80)) for p in "abc")
    assert sorted(x.text for x in simhash.keep_one(documents([(7, a), (7, b), (8, c), (7, a), (9, a)])).collect()) == [a, b, c]
    odd = spark.createDataFrame([(1, a, 5, "k"), (2, a, 6, "l")], "doc_id long, text string, _row int, _FP string")
    assert [tuple(x) for x in simhash.keep_one(odd).collect()] == [(1, a, 5, "k")]
    assert simhash.keep_one(documents([])).count() == 0


def test_query_equals_brute_force(spark, small):
    from voxframe.llm.queries import op1_simhash

    docs = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = brute_components(docs)
    got = op1_simhash(spark, small).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{docs[d]:016x}", want[d]) for d in docs}


def test_keep_one_leaves_unlinked_texts_in_place(documents, spark):
    """Texts that no other one is like are not shuffled, however Spark would join them."""
    from pathlib import Path

    r = random.Random(3)
    texts = [" ".join(f"{r.getrandbits(48):x}" for _ in range(1500)) for _ in range(200)]
    rows = [*enumerate(texts), (900, texts[0]), (901, texts[1] + " more"), (902, "x " + texts[1])]
    folders = [str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: sum(f.stat().st_size for d in folders for f in Path(d).rglob("shuffle_*.data"))
    frame, before = documents(rows), shuffled()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(x.doc_id for x in simhash.keep_one(frame).collect()) == list(range(200))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert shuffled() - before < 0.25 * sum(map(len, texts))


def test_copy_links_of_equal_bands(spark):
    """Bands shared by the same texts are searched once, those shared by others as well: no link is lost."""
    words = [f"w{i}" for i in range(100)]
    texts = {1: words, 2: [*words, "a"], 3: ["b", *words], 4: [f"v{i}" for i in range(100)], 5: [f"v{i}" for i in range(101)]}
    texts = {i: " ".join(w) for i, w in texts.items()}
    bands = {1: [7, 7, 5], 2: [7, 7, 6], 3: [1, 2, 5], 4: [7, 3, 3], 5: [8, 3, 3]}
    signed = lambda x: x - (x >> 63 << 64)
    marks = spark.createDataFrame([(i, signed(simhash.fingerprint(t, 5)), bands[i], 97) for i, t in texts.items()], "id long, fp long, bands array<long>, n_shingles long")
    links = {tuple(sorted(x)) for x in simhash.copy_links(marks, spark.createDataFrame(list(texts.items()), "id long, text string"), 24, 0.8).collect()}
    assert links == {(1, 2), (1, 3), (4, 5)}

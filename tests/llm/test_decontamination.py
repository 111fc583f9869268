from __future__ import annotations

import hashlib
import random
import re

import pytest
from voxframe.llm import decontamination as D


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(doc, items, window):
    words, hit, found = words_of(doc), set(), set()
    for item, text in items:
        own = words_of(text)
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if own else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == own[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


@pytest.mark.parametrize("max_words", [D.MAX_ITEM_WORDS, 12])
def test_equals_brute_force(spark, documents, max_words):
    r = random.Random(5)
    text = lambda n, letters: " ".join(r.choice(letters) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 5, 6, 9]), "abcd")) for i in range(14)] + [(20, None), (21, "..!"), (22, "A b C d A b"), (23, "a b c d a b")]
    docs = [(i, text(r.randint(0, 60), "aBcde,")) for i in range(80)] + [(100, None), (101, ""), (102, "a b c d a b"), (102, "a b c d a b")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = D.digest(D.find_leaks(documents(docs), benchmark, window=4, max_words=max_words)).collect()
    want = sorted((d, *brute(t, items, 4)) for d, t in docs)
    assert sorted(tuple(r) for r in got) == want


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.digest(D.find_leaks(documents([]), none)).count() == 0
    assert [tuple(r)[1:4] for r in D.digest(D.find_leaks(documents([(1, "a b")]), none)).collect()] == [(2, 0, 0)]


def test_batches_of_items_give_what_one_automaton_gives(spark, documents):
    """Also of items without an id, and of two under one id."""
    r = random.Random(6)
    text = lambda n, letters: " ".join(r.choice(letters) for _ in range(n))
    items = [(i % 9, text(r.choice([3, 5, 8]), "abcd")) for i in range(14)] + [(None, "e a e a"), (None, None)]
    docs = documents([(i, text(r.randint(0, 50), "aBcde,")) for i in range(60)] + [(7, "e a e a"), (None, "e a e a b"), (8, None)])
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, many = ([sorted(map(str, f(docs, benchmark, window=4, max_words=w).collect())) for f in (D.find_leaks, D.clean)] for w in (10_000, 9))
    assert one == many


def test_clean_cuts_spans_and_drops_what_is_mostly_leaked(spark, documents):
    passage = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(30))
    docs = documents([(1, f"{filler}. {passage.upper()}! {filler}"), (2, passage), (3, filler), (4, None)])
    out = {r.doc_id: r for r in D.clean(docs, benchmark).collect()}
    assert set(out) == {1, 3, 4}
    assert out[1].text == f"{filler}. ! {filler}" and out[1].n_chars == len(out[1].text)
    assert out[3].text == filler and out[4].text is None
    assert D.clean(docs, benchmark).columns == docs.columns

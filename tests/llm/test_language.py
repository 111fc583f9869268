from __future__ import annotations

import math
import zlib

import numpy as np
from pyspark.sql import functions as F
from voxframe.llm import language as L
from voxframe.llm.tokenization import vocabulary_path

PIECES = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5, "ba": 6, "▁ab": 7}


def brute(word: str, p: np.ndarray) -> float:
    """The sum over all segmentations, written out."""
    def rest(w: str) -> float:
        if not w:
            return 1.0
        total = 0.0
        for k in range(1, len(w) + 1):
            piece = PIECES.get(w[:k], 0 if k == 1 else None)
            if piece is not None:
                total += p[piece] * rest(w[k:])
        return total

    return rest("▁" + word)


def test_forward_sums_all_segmentations():
    r = np.random.default_rng(1)
    p = r.random((8, 3))
    p /= p.sum(0)
    words = ["a", "b", "ab", "aba", "abab", "xay", "bbbbb"]
    got = L.Lattice(words, L.Trie(PIECES)).log_likelihood(p)
    for w, row in zip(words, got):
        for k in range(3):
            assert math.isclose(row[k], math.log(brute(w, p[:, k])), rel_tol=1e-9)


def test_long_words_are_summed_whole():
    r = np.random.default_rng(2)
    p = r.random((8, 3))
    p /= p.sum(0)
    words = ["".join(r.choice(list("abx"), n)) for n in (1, 5, 30, 39)]
    for w, row in zip(words, L.Lattice(words, L.Trie(PIECES)).log_likelihood(p)):
        assert np.allclose(L.long_word(w, PIECES, p), row, rtol=1e-9)
    tall = L.long_word("ab" * 3000, PIECES, p * 1e-3)
    assert np.isfinite(tall).all() and (tall < -10_000).all()
    model = L.Model(["x", "y"], PIECES, p[:, :2])
    want = model.predict(["ab " + "ba" * 30])[0]
    total = model.predict(["ab"]) and model.scores[model.known["ab"]] + L.long_word("ba" * 30, PIECES, p[:, :2])
    assert want == (model.languages[int(total.argmax())], float(1 / np.exp(total - total.max()).sum()))


def test_expected_counts_and_rising_likelihood():
    words, counts = ["ab", "aba", "b", "abab"], np.array([3.0, 1.0, 2.0, 4.0])
    lattice = L.Lattice(words, L.Trie(PIECES))
    p = np.full((8, 1), 1 / 8)
    before = -np.inf
    for _ in range(6):
        now = float((lattice.log_likelihood(p)[:, 0] * counts).sum())
        assert now >= before - 1e-9
        before = now
        use = lattice.expected(p, counts)
        p = (use / use.sum())[:, None]


def test_learns_and_predicts(spark, documents, odd_texts):
    en = ["the house and the river are by the stone bridge in the morning " * 3] * 20
    de = ["das haus und der fluss sind bei der alten brücke am morgen früh " * 3] * 20
    docs = [(i, t, "en") for i, t in enumerate(en)] + [(100 + i, t, "de") for i, t in enumerate(de)] + [(200 + (d or 0), t, None) for d, t in odd_texts] + [(300, "1234 _ !!"), (301, "²³"), (302, "the river"), (None, "der fluss am morgen", "de")]
    frame = documents(docs)
    model = L.fit(frame, vocabulary_path("piece_bpe_32k.model"), ~L.held_out(F.col("doc_id")))
    rows = L.predict(frame, model).collect()
    assert len(rows) == len(docs)
    out = {r.doc_id: r for r in rows}
    assert all(out[i].lang_pred == "en" for i in range(20)) and all(out[100 + i].lang_pred == "de" for i in range(20))
    assert [out[i].lang_pred for i in (201, 202, 203, 300, 301)] == ["und"] * 5 and out[201].score == 0
    assert out[302].lang_pred == "en" and out[None].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    kept = L.keep(frame, model)
    assert kept.columns == frame.columns and {201, 202, 203, 300, 301}.isdisjoint(r.doc_id for r in kept.collect())


def test_nothing_to_learn_from(spark, documents):
    path = vocabulary_path("piece_bpe_32k.model")
    assert L.predict(documents([]), L.fit(documents([]), path)).count() == 0
    unlabelled = documents([(1, "the river", None)])
    assert [tuple(r)[2:] for r in L.predict(unlabelled, L.fit(unlabelled, path)).collect()] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    from voxframe.llm.queries import op10_language

    d = "/root/testdata/sf0.01"
    rows = op10_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)

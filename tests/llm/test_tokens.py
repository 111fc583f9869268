from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from voxframe.llm import packing, token_files, tokenization

BYTE, WORD = (tokenization.vocabulary_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
MEMOS = {True: tokenization.WordMemo(BYTE, True, "<u4", limit=60), False: tokenization.WordMemo(WORD, False, "<u4", limit=60)}
#: The library's own, with nothing set.
PLAIN = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
SPECIAL = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|", "  <|endoftext|>  ", "it's", "x9!!", "don't."]


def ids_of(path: str, text, end: int | None) -> bytes:
    ids = PLAIN[path].encode(text or "", add_special_tokens=False).ids
    return np.array(ids if end is None else [*ids, end], "<u4").tobytes()


TEXT = st.text(alphabet=st.sampled_from(" \n\t.,'sTaébA9%&İß́Σς\x85\xa0\x1c<|>!-"), max_size=30) | st.text(max_size=20)
MIXED = st.lists(TEXT | st.sampled_from(SPECIAL), max_size=5).map("".join)


@pytest.mark.parametrize("leading", [True, False])
@settings(max_examples=400, deadline=None)
@given(texts=st.lists(TEXT | MIXED, max_size=6))
def test_memo_equals_plain_encoding(leading, texts):
    memo, path = MEMOS[leading], BYTE if leading else WORD
    assert memo.encode_all(texts) == [ids_of(path, t, None) for t in texts]
    assert memo.encode_all([None]) == [b""]


def test_memo_keeps_two_generations():
    memo = tokenization.WordMemo(BYTE, True, "<u2", limit=20)
    for k in range(50):
        texts = [f"the word{k} and again" for _ in range(2)]
        assert memo.encode_all(texts, block=1) == [np.frombuffer(ids_of(BYTE, t, None), "<u4").astype("<u2").tobytes() for t in texts]
        assert len(memo.young) <= 10 and len(memo.old) <= 10


def test_token_files_round_trip(spark, documents, odd_texts, tmp_path):
    docs = documents(odd_texts)
    folder = f"file://{tmp_path}/set"
    manifest = token_files.write_token_files(docs, BYTE, 0, folder, partitions=3)
    parts = sorted(manifest.collect(), key=lambda r: r.part)
    assert [p.base for p in parts] == [sum(q.n_ids for q in parts[:k]) for k in range(len(parts))]
    got = token_files.read_token_files(manifest, folder).collect()
    ordered = sorted(odd_texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for d, text in ordered:
        raw = ids_of(BYTE, text, 0)
        want.append((d, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    key = lambda r: r[1]
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=key) == want
    # the files are flat: all parts one after the other are all ids
    whole = b"".join(np.fromfile(f"{tmp_path}/set/{p.name}.bin", "<u2").astype("<u4").tobytes() for p in parts)
    assert whole == b"".join(ids_of(BYTE, t, 0) for _, t in ordered)


def test_token_files_of_nothing(documents):
    assert token_files.token_file_digest(documents([]), BYTE).count() == 0


def test_a_failed_task_leaves_no_trace_in_the_manifest(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/set"
    (tmp_path / "set").mkdir()
    (tmp_path / "set/000000-dead.bin").write_bytes(b"\1\0")
    manifest = token_files.write_token_files(documents([(1, "a b")]), BYTE, 0, folder, partitions=1)
    assert [r.doc_id for r in token_files.read_token_files(manifest, folder).collect()] == [1]


def check_packing(rows, odd_texts, capacity):
    per_doc: dict = {}
    for r in rows:
        per_doc.setdefault((r.doc_id), []).append(r)
    for d, text in odd_texts:
        raw = ids_of(WORD, text, 1)
        size = len(raw) // 4
        copies = sum(1 for e, _ in odd_texts if e == d)
        own = sorted(per_doc[d], key=lambda r: r.piece)
        assert sum(r.length for r in own) == size * copies
        for r in own:
            assert r.start == r.piece * capacity and r.ids_crc32 == zlib.crc32(raw[4 * r.start : 4 * (r.start + r.length)])
    bins: dict = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [4096, 7])
def test_packing(documents, odd_texts, capacity):
    rows = packing.pack_documents(documents(odd_texts), WORD, 1, capacity).collect()
    check_packing(rows, odd_texts, capacity)
    assert packing.pack_documents(documents([]), WORD, 1).count() == 0


def best_possible(items: list[int], capacity: int) -> int:
    items = sorted(items, reverse=True)
    best = len(items)

    def place(k: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + items[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    """Fixing dominating sets never costs a bin: what is fixed plus the best for the rest is the best for all."""
    for seed in range(150):
        r = random.Random(seed)
        items = [r.randint(1, 20) for _ in range(r.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        rest, fixed = packing.reduce_dominated(counts, 20)
        assert all(sum(group) <= 20 for group, _ in fixed)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + best_possible(left, 20) == best_possible(items, 20), (seed, items)


def test_few_sequences():
    r = random.Random(0)
    counts: dict[int, int] = {}
    for _ in range(20000):
        x = min(4096, int(r.lognormvariate(6, 1)) + 1)
        counts[x] = counts.get(x, 0) + 1
    table = packing.slots(counts)
    total = sum(x * n for x, n in counts.items())
    assert table[:, 2].max() + 1 <= 1.002 * total / 4096 + 1


def test_op5_and_op9_on_the_small_table(spark, small):
    from voxframe.llm.queries import op5_packing, op9_token_files

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    check_packing(op5_packing(spark, small).collect(), docs, 4096)
    at, want = 0, []
    for d, t in sorted(docs):
        raw = ids_of(BYTE, t, 0)
        want.append((d, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    assert sorted(tuple(r) for r in op9_token_files(spark, small).collect()) == want


def test_memo_looks_a_part_up_once_for_many_texts():
    """Lookups in the large memo grow with the different parts of a block, not with its words."""

    class Counted(dict):
        asked = 0

        def get(self, *a):
            Counted.asked += 1
            return dict.get(self, *a)

    memo = tokenization.WordMemo(BYTE, True, "<u4")
    memo.young = Counted()
    texts = ["the same few words and the same few words " * 20] * 30 + ["other words"]
    for _ in range(2):
        assert memo.encode_all(texts) == [ids_of(BYTE, t, None) for t in texts]
    assert Counted.asked <= 2 * 12


def test_a_worker_holds_one_memo_at_a_time():
    from voxframe.llm import _common, quality

    quality.buckets([b"a", b"b"])
    first = tokenization.memo(BYTE, True, "<u2")
    assert tokenization.memo(BYTE, True, "<u2") is first and list(_common._HELD.values()) == [first]
    assert len(quality.buckets([b"a", b"b"])) == 3 and first not in _common._HELD.values()

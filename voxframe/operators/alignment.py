"""Word alignment, error counts and dictionary-assisted correction.

Alignment is quadratic and sequential, so it runs in UDFs of Arrow arrays, on the matrices of many pairs of similar size
at once: an antidiagonal of all of them is one step, and so is a step of all walks back. A pair whose matrix is over CELLS
takes its rows one by one, each one running minimum. Among the alignments of least distance the one is taken that, walked from the end, prefers a
deletion to an insertion and that to a match or substitution, after common words at both ends are set aside. Of matrices
over CELLS only some rows are kept, and those between are made again as the walk gets there: the same path, with memory
of some 2 * sqrt(rows) rows.

An empty reference has no error rate: wer is null, all hypothesis words are insertions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions import fixed_values as V
from voxframe.functions.lazy import arrow_udf

#: Cells of a matrix that is kept whole for the walk back; of all matrices that are made at once.
CELLS = 4_000_000
#: Words of the pairs that are looked at together.
WORDS = 1_000_000
OPS = ("equal", "substitute", "insert", "delete")
CHUNKS = "array<struct<op: string, rs: int, re: int, hs: int, he: int>>"
RESULT_STRUCT = f"struct<hits: int, sub: int, ins: int, del: int, wer: double, chunks: {CHUNKS}>"
RESULT = f"hits int, sub int, ins int, del int, wer double, chunks {CHUNKS}"


def _numbers(ref, hyp) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers; equal words have equal ones."""
    numbers: dict[str, int] = {}
    sides = ([] if words is None else words for words in (ref, hyp))
    a, b = (np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in sides)
    return a, b


def _rows(a: np.ndarray, b: np.ndarray, row: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Rows of the distance matrix of two sequences of word numbers; row: the first, where it is not the matrix's own."""
    places = np.arange(len(b) + 1, dtype=np.int64)
    row = places.copy() if row is None else row
    yield row
    for x in a:
        best = np.empty_like(row)
        best[0] = row[0] + 1
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(best - places) + places
        yield row


def distance(a: np.ndarray, b: np.ndarray) -> int:
    last = 0
    for row in _rows(a, b):
        last = int(row[-1])
    return last


def _walk(a: np.ndarray, b: np.ndarray) -> list[str]:
    n, m = len(a), len(b)
    step = max(1, n if n * m <= CELLS else isqrt(n))
    kept = [row for i, row in enumerate(_rows(a, b)) if i % step == 0]
    ops, i, j = [], n, m
    for first in range(max(0, n - 1) // step * step, -1, -step):
        d = np.stack(list(_rows(a[first : first + step], b, kept[first // step])))
        while i > first or (first == 0 and j):
            here = d[i - first, j]
            if i and here == d[i - 1 - first, j] + 1:
                ops.append("delete")
                i -= 1
            elif j and here == d[i - first, j - 1] + 1:
                ops.append("insert")
                j -= 1
            else:
                ops.append("equal" if a[i - 1] == b[j - 1] else "substitute")
                i, j = i - 1, j - 1
    return ops[::-1]


def align(ref: list[str], hyp: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Chunks (op, ref start, ref end, hyp start, hyp end) of equal, substitute, delete and insert."""
    a, b = _numbers(ref, hyp)
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    rest = n - head
    differ = np.flatnonzero(a[len(a) - rest :][::-1] != b[len(b) - rest :][::-1])
    tail = int(differ[0]) if len(differ) else rest
    ops = ["equal"] * head + _walk(a[head : len(a) - tail], b[head : len(b) - tail]) + ["equal"] * tail
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for op in ops:
        di, dj = op != "insert", op != "delete"
        if out and out[-1][0] == op:
            out[-1] = (op, out[-1][1], i + di, out[-1][3], j + dj)
        else:
            out.append((op, i, i + di, j, j + dj))
        i, j = i + di, j + dj
    return out


def counts(chunks: list[tuple[str, int, int, int, int]]) -> tuple[int, int, int, int, float | None]:
    n = {"equal": 0, "substitute": 0, "insert": 0, "delete": 0}
    for op, rs, re_, hs, he in chunks:
        n[op] += he - hs if op == "insert" else re_ - rs
    words = n["equal"] + n["substitute"] + n["delete"]
    return n["equal"], n["substitute"], n["insert"], n["delete"], (n["substitute"] + n["insert"] + n["delete"]) / words if words else None


class _Pairs:
    """Pairs of word lists as numbers: ``words``, and where each list starts and how long it is. Nulls are empty lists."""

    def __init__(self, ref: pa.Array, hyp: pa.Array):
        self.n, self.m = (pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ref, hyp))
        both = pa.concat_arrays([ref.flatten(), hyp.flatten()]).dictionary_encode(null_encoding="encode")
        self.words = np.append(both.indices.to_numpy(), -1)  # one more, so that there is always one
        self.a = np.cumsum(self.n) - self.n
        self.b = np.cumsum(self.m) - self.m + self.n.sum()

    def __len__(self) -> int:
        return len(self.n)

    def one(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        return self.words[self.a[r] : self.a[r] + self.n[r]], self.words[self.b[r] : self.b[r] + self.m[r]]

    def _common(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, way: int) -> np.ndarray:
        """How many words from places a and b on are the same, of n at most."""
        starts = np.cumsum(n) - n
        i = np.arange(n.sum()) - np.repeat(starts, n)
        differ = np.append(np.flatnonzero(self.words[np.repeat(a, n) + way * i] != self.words[np.repeat(b, n) + way * i]), len(i))
        return np.minimum(differ[np.searchsorted(differ, starts)] - starts, n)

    def strip(self) -> tuple[np.ndarray, np.ndarray]:
        """Sets common words at both ends aside: how many."""
        least = np.minimum(self.n, self.m)
        head = self._common(self.a, self.b, least, 1)
        tail = self._common(self.a + self.n - 1, self.b + self.m - 1, least - head, -1)
        self.a, self.b, self.n, self.m = self.a + head, self.b + head, self.n - head - tail, self.m - head - tail
        return head, tail

    def large(self) -> np.ndarray:
        """Pairs that take their rows one by one."""
        return np.flatnonzero((self.n + self.m + 1) * (self.n + 1) > CELLS)

    def matrices(self, way: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs' numbers and their distance matrices, of all that are not large: d[i + j, i, pair]. way: -1 from the ends."""
        order = np.lexsort((self.m, self.n))
        order = order[(self.n[order] + self.m[order] + 1) * (self.n[order] + 1) <= CELLS]
        first = 0
        while first < len(order):
            # pairs come by n, and so does what a pair more needs
            some = order[first : first + 512]
            cells = (self.n[some] + np.maximum.accumulate(self.m[some]) + 1) * (self.n[some] + 1) * np.arange(1, len(some) + 1)
            some = some[: max(1, int(np.searchsorted(cells, CELLS // 2, "right")))]
            first += len(some)
            yield some, self._matrix(some, way)

    def _side(self, starts: np.ndarray, sizes: np.ndarray, way: int, none: int) -> np.ndarray:
        i = np.arange(sizes.max())[:, None]
        places = starts + i if way > 0 else starts + sizes - 1 - i
        return np.where(i < sizes, self.words[np.clip(places, 0, len(self.words) - 1)], none)

    def _matrix(self, some: np.ndarray, way: int) -> np.ndarray:
        a = self._side(self.a[some], self.n[some], way, -1)
        b = np.ascontiguousarray(self._side(self.b[some], self.m[some], way, -2)[::-1])
        n, m = len(a), len(b)
        d = np.empty((n + m + 1, n + 1, len(some)), np.int16 if n + m < 32_000 else np.int32)
        for k in range(n + m + 1):
            if k <= m:
                d[k, 0] = k
            if k <= n:
                d[k, k] = k
            lo, hi = max(1, k - m), min(n, k - 1) + 1
            if lo < hi:
                here = d[k, lo:hi]
                np.minimum(d[k - 1, lo - 1 : hi - 1], d[k - 1, lo:hi], out=here)
                here += 1
                np.minimum(here, d[k - 2, lo - 1 : hi - 1] + (a[lo - 1 : hi - 1] != b[m - k + lo : m - k + hi]), out=here)
        return d

    def walks(self, some: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps back from the pairs' last cells, ops[step, pair], and how many."""
        _, width, count = d.shape
        flat, row = d.reshape(-1), width * count
        ops = np.zeros((int((self.n[some] + self.m[some]).max()), count), np.int8)
        taken = np.zeros(count, np.int64)
        pair = np.flatnonzero(self.n[some] + self.m[some])
        i, j = self.n[some][pair], self.m[some][pair]
        for step in range(len(ops)):
            at = (i + j) * row + i * count + pair
            here = flat[at]
            deleted = (i > 0) & (here == flat[at - row - count] + 1)
            inserted = ~deleted & (j > 0) & (here == flat[at - row] + 1)
            same = here == flat[at - 2 * row - count]
            ops[step, pair] = np.where(deleted, 3, np.where(inserted, 2, np.where(same, 0, 1)))
            i, j = i - ~inserted, j - ~deleted
            more = i + j > 0
            if not more.all():
                taken[pair[~more]] = step + 1
                pair, i, j = pair[more], i[more], j[more]
                if not len(pair):
                    break
        return ops, taken


def _parts(ref: pa.Array, hyp: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Consecutive pairs, so many that their words are some WORDS; empty arrays are a part."""
    words = np.cumsum(sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ref, hyp)))
    cuts = [0, *(np.flatnonzero(np.diff(words // WORDS)) + 1).tolist(), len(ref)]
    for x, y in zip(cuts, cuts[1:]):
        yield ref.slice(x, y - x), hyp.slice(x, y - x)


def _ops(pairs: _Pairs) -> tuple[np.ndarray, np.ndarray]:
    """The steps of all pairs' alignments, one pair's after the other's, and how many each has."""
    head, tail = pairs.strip()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    sizes = head + tail
    for some, d in pairs.matrices():
        ops, taken = pairs.walks(some, d)
        found.append((some, ops, taken))
        sizes[some] += taken
    code = {op: i for i, op in enumerate(OPS)}
    for r in pairs.large():
        ops = np.array([[code[op]] for op in _walk(*pairs.one(r))[::-1]], np.int8)
        found.append((np.array([r]), ops, np.array([len(ops)])))
        sizes[r] += len(ops)
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(sizes.sum(), np.int8)
    for some, ops, taken in found:
        step = np.arange(len(ops))[:, None]
        there = step < taken
        out[(starts[some] + head[some] + taken - 1 - step)[there]] = ops[there]
    return out, sizes


def _aligned(ref: pa.Array, hyp: pa.Array) -> pa.StructArray:
    ops, sizes = _ops(_Pairs(ref, hyp))
    starts = np.cumsum(sizes) - sizes
    pair = np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(ops), bool)
    new[1:] = (ops[1:] != ops[:-1]) | (pair[1:] != pair[:-1])
    first = np.flatnonzero(new)
    after = np.append(first[1:], len(ops))
    places = []
    for other in (2, 3):  # words of ref, which insertions have none of, and of hyp
        words = np.concatenate([[0], np.cumsum(ops != other)])
        own = words[starts[pair[first]]]
        places += [pa.array((words[x] - own).astype(np.int32)) for x in (first, after)]
    chunk = pa.StructArray.from_arrays([pa.array(OPS).take(pa.array(ops[first].astype(np.int32))), *places], ["op", "rs", "re", "hs", "he"])
    offsets = np.searchsorted(first, np.append(starts, len(ops))).astype(np.int32)
    n = np.bincount(pair * 4 + ops, minlength=4 * len(sizes)).reshape(-1, 4)
    words = n[:, 0] + n[:, 1] + n[:, 3]
    wer = pa.array((n[:, 1] + n[:, 2] + n[:, 3]) / np.maximum(words, 1), mask=words == 0)
    counted = [pa.array(n[:, k].astype(np.int32)) for k in range(4)]
    return pa.StructArray.from_arrays([*counted, wer, pa.ListArray.from_arrays(pa.array(offsets), chunk)], ["hits", "sub", "ins", "del", "wer", "chunks"])


@arrow_udf(RESULT, once=True)
def align_words(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return pa.concat_arrays([_aligned(*part) for part in _parts(ref, hyp)])


@arrow_udf("long")
def word_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """The distance alone: memory of a large pair is one row."""
    found = []
    for part in _parts(ref, hyp):
        pairs = _Pairs(*part)
        pairs.strip()
        out = np.zeros(len(pairs), np.int64)
        for some, d in pairs.matrices():
            n, m = pairs.n[some], pairs.m[some]
            out[some] = d[n + m, n, np.arange(len(some))]
        for r in pairs.large():
            out[r] = distance(*pairs.one(r))
        found.append(out)
    return pa.array(np.concatenate(found))


def trimmed_distances(a: np.ndarray, b: np.ndarray, trims: int) -> tuple[list[int], list[int]]:
    """Distances with the first 0, 1, ... ``trims`` words of a cut, and of b, as far as there are words.

    In the matrix of both sequences from their ends, what is left of a sequence is a row or a column.
    """
    n, m = len(a), len(b)
    cut_a: list[int] = []
    row = np.zeros(1, np.int64)
    for i, row in enumerate(_rows(a[::-1], b[::-1])):
        if i >= n - trims:
            cut_a.append(int(row[m]))
    return cut_a[::-1], [int(row[m - t]) for t in range(min(trims, m) + 1)]


def _trimmed(ref: pa.Array, hyp: pa.Array, trims: int) -> pa.StructArray:
    pairs = _Pairs(ref, hyp)
    t = np.arange(trims + 1)
    out = np.zeros((2, len(pairs), trims + 1), np.int64)
    for some, d in pairs.matrices(-1):
        n, m, one = pairs.n[some][:, None], pairs.m[some][:, None], np.arange(len(some))[:, None]
        i, j = np.maximum(n - t, 0), np.maximum(m - t, 0)
        out[0, some], out[1, some] = d[i + m, i, one], d[n + j, n, one]
    for r in pairs.large():
        for side, found in enumerate(trimmed_distances(*pairs.one(r), trims)):
            out[side, r, : len(found)] = found
    sides = []
    for size, found in zip((pairs.n, pairs.m), out):
        there = t <= size[:, None]
        offsets = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
        sides.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[there])))
    return pa.StructArray.from_arrays(sides, ["cut_ref", "cut_hyp"])


def trims_udf(trims: int):
    """(ref, hyp) -> distances by trimmed words of ref, and of hyp, from one matrix."""

    @arrow_udf("cut_ref array<long>, cut_hyp array<long>", once=True)
    def cuts(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        return pa.concat_arrays([_trimmed(*part, trims) for part in _parts(ref, hyp)])

    return cuts


def with_alignment(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """pairs with hits, sub, ins, del, wer, chunks; ref and hyp are arrays of words."""
    # the UDF is planned once: as it must not be copied, filters on its result stay above it
    return pairs.withColumn("_a", align_words(F.col(ref), F.col(hyp))).select(*pairs.columns, "_a.*")


def _top(found: pa.Array, k: int) -> pa.Array:
    ops, ref, hyp = (x.dictionary_encode(null_encoding="encode") for x in found.flatten().flatten())
    pair = np.repeat(np.arange(len(found)), pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False))
    op, r, h = (x.indices.to_numpy().astype(np.int64) for x in (ops, ref, hyp))
    _, texts = np.unique(r * max(1, len(hyp.dictionary)) + h, return_inverse=True)
    group = pair * len(OPS) + op
    _, first, cnt = np.unique(group * (len(texts) + 1) + texts, return_index=True, return_counts=True)
    order = np.lexsort((first, -cnt, group[first]))
    first, cnt = first[order], cnt[order]
    own = group[first]
    start = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    kept = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own)))) < k
    first, cnt = first[kept], cnt[kept]
    offsets = np.searchsorted(pair[first], np.arange(len(found) + 1)).astype(np.int32)
    columns = [x.dictionary.take(pa.array(i[first])) for x, i in ((ops, op), (ref, r), (hyp, h))]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([*columns, pa.array(cnt)], ["op", "ref_text", "hyp_text", "cnt"]))


def with_own_top(aligned: DataFrame, k: int = V.TOP, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """aligned with ``top``: (op, ref_text, hyp_text, cnt) of the k most frequent chunks of each kind in the row itself, by
    kind and rank; what top_errors gives for keys that each row has alone, without a shuffle."""

    @arrow_udf("array<struct<op: string, ref_text: string, hyp_text: string, cnt: long>>", once=True)
    def top(found: pa.Array) -> pa.Array:
        return _top(found, k)

    wrong = F.filter("chunks", lambda c: c["op"] != "equal")  # in the order of their places
    texts = lambda c: F.struct(c["op"].alias("op"), _part(ref, c["rs"], c["re"]).alias("ref_text"), _part(hyp, c["hs"], c["he"]).alias("hyp_text"))
    return aligned.withColumn("top", top(F.transform(wrong, texts)))


def _part(words: str, a, b) -> Column:
    return F.array_join(F.slice(F.col(words), a + 1, b - a), " ")


def errors(aligned: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """One row per erroneous chunk: keys, op, ref_text, hyp_text, position."""
    chunk = F.explode("chunks").alias("c")
    rows = aligned.select(*keys, ref, hyp, chunk).where(F.col("c.op") != "equal")
    return rows.select(*keys, F.col("c.op").alias("op"), _part(ref, F.col("c.rs"), F.col("c.re")).alias("ref_text"), _part(hyp, F.col("c.hs"), F.col("c.he")).alias("hyp_text"), F.col("c.rs").alias("rs"), F.col("c.hs").alias("hs"))


def top_errors(found: DataFrame, keys: list[str], k: int = V.TOP) -> DataFrame:
    """The k most frequent chunks of each kind; of equally frequent ones those that came first, then by their texts."""
    counted = found.groupBy(*keys, "op", "ref_text", "hyp_text").agg(F.count("*").alias("cnt"), F.min(F.struct("rs", "hs")).alias("first"))
    by = Window.partitionBy(*keys, "op").orderBy(F.desc("cnt"), "first", "ref_text", "hyp_text")
    return counted.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).drop("first")


def examples(top: DataFrame, keys: list[str]) -> DataFrame:
    """The most frequent substitution, deletion and insertion as lines, in this order."""
    first = top.where("rank = 1")
    line = (
        F.when(F.col("op") == "substitute", F.format_string("SUB (%dx): '%s' -> '%s'", "cnt", "ref_text", "hyp_text"))
        .when(F.col("op") == "delete", F.format_string("DEL (%dx): '%s'", "cnt", "ref_text"))
        .otherwise(F.format_string("INS (%dx): '%s'", "cnt", "hyp_text"))
    )
    place = F.when(F.col("op") == "substitute", 1).when(F.col("op") == "delete", 2).otherwise(3)
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("k"), line.alias("line")))), lambda x: x["line"]).alias("examples"))


def apply_variants(aligned: DataFrame, mapping: DataFrame, keys: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """aligned with corrected (hyp in which substituted words that a map holds for the same are said as in ref),
    spans_checked and tokens_replaced.

    mapping: variant, canonical (unique variants). Different pairs of words are looked up, once each, so a word that is
    heard everywhere is one row a partner, and the texts go through one shuffle by key alone. aligned is read several times:
    pass a written table. Spark broadcasts the map if it is small enough.
    """
    same_size = F.filter("chunks", lambda c: (c["op"] == "substitute") & (c["re"] - c["rs"] == c["he"] - c["hs"]))
    each = lambda c: F.transform(F.sequence(F.lit(0), c["re"] - c["rs"] - 1), lambda i: F.struct((c["hs"] + i).alias("at"), F.element_at(F.col(ref), c["rs"] + i + 1).alias("word"), F.element_at(F.col(hyp), c["hs"] + i + 1).alias("said")))
    names = [f"_k{i}" for i in range(len(keys))]
    words = aligned.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.explode(F.flatten(F.transform(same_size, each))).alias("_x")).select(*names, "_x.*").where("word != said")
    left = mapping.select(F.col("variant").alias("_v1"), F.col("canonical").alias("_c1"))
    right = mapping.select(F.col("variant").alias("_v2"), F.col("canonical").alias("_c2"))
    found = words.select("word", "said").distinct().join(left, F.lower("word") == F.col("_v1"), "left").join(right, F.lower("said") == F.col("_v2"), "left")
    same = found.where(F.coalesce("_c1", F.lower("word")) == F.coalesce("_c2", F.lower("said"))).select("word", "said")
    fixes = words.join(same, ["word", "said"]).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("_fix"))
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    out = aligned.join(fixes, on, "left").drop(*names)
    replaced = F.when(F.col("_fix").isNull(), 0).otherwise(F.size("_fix"))
    fixed = F.transform(F.col(hyp), lambda w, i: F.coalesce(F.try_element_at(F.col("_fix"), i), w))
    spans = F.size(F.filter("chunks", lambda c: c["op"] == "substitute"))
    return out.withColumn("corrected", F.when(F.col("_fix").isNull(), F.col(hyp)).otherwise(fixed)).withColumn("spans_checked", spans).withColumn("tokens_replaced", replaced).drop("_fix")

"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised (A-Z lower-cased, words cut by WORD) and their word numbers fed into one suffix automaton. A
document's words run through it; the automaton's state and length are the longest suffix read so far that occurs in any
item. A length of ``window`` or more means that the last ``window`` words are a window of some item; the state reached by
suffix links that still holds ``window`` words knows which items have it. Items shorter than a window count whole.

The automaton is broadcast, so its size is bounded: one takes MAX_ITEM_WORDS words of items (some 1.1 kB a word, measured).
Of a larger benchmark one batch of items after the other is read, built, sent and run over all documents, its finds are
written, and finds are merged by row in the end; nothing is dropped, and no two automata are held at a time.

Defined results: null and empty texts have no words and are clean; null and wordless items never occur; items
with equal item_ids count as one item, and a null item_id is named by the empty string; repeated documents give repeated
rows; an empty benchmark hits nothing;
columns of other names are ignored, or kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, map_arrow, record, rows_of, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
WINDOW = 10
#: Words of one automaton (an item with more has one of its own).
MAX_ITEM_WORDS = 100_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


class SuffixAutomaton:
    """Of all items' word sequences; find(words) gives what occurs where."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window, self.ids = window, [i for i, _ in items]
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: list[set[int]] = [set()]
        shorts: list[tuple[int, int]] = []
        self.least = window
        for k, (_, words) in enumerate(items):
            if not words:
                continue
            last = 0
            for w in words:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)), owners)
                owners[last].add(k)
            if len(words) < window:
                shorts.append((last, k))
                self.least = min(self.least, len(words))
        by_length = sorted(range(len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in by_length:  # an item that reaches a state reaches all its suffixes
            if self.link[s] > 0:
                owners[self.link[s]] |= owners[s]
        #: items with a window whose last words are this state's, and short items that are a suffix of it: (length, item)
        self.owners = [frozenset(x) for x in owners]
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for s, k in shorts:
            self.short[s].append((len(items[k][1]), k))
        for s in reversed(by_length):
            if self.link[s] >= 0:
                self.short[s] = self.short[s] + self.short[self.link[s]]

    def _extend(self, last: int, c: int, owners: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(c)
        if q is not None:
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q, owners)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        owners.append(set())
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q, owners)
        return new

    def _clone(self, p: int, c: int, q: int, owners: list[set[int]]) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        owners.append(set())
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def find(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int], int]:
        """(spans of hit words, disjoint and in order; items with occurring windows; longest match, 0 if it is no window)."""
        numbers = list(map(self.vocabulary.get, words))
        spans: list[list[int]] = []
        found: set[int] = set()
        longest = 0
        nxt, link, length, window = self.next, self.link, self.length, self.window
        at, n, least = 0, len(numbers), self.least
        while at + least <= n:
            # a stretch without unknown words that is too short for any window is left out
            try:
                stop = numbers.index(None, at)
            except ValueError:
                stop = n
            if stop - at < least:
                at = stop + 1
                continue
            state = size = 0
            for i in range(at, stop):
                c = numbers[i]
                while c not in nxt[state] and state:
                    state = link[state]
                    size = length[state]
                if c in nxt[state]:
                    state, size = nxt[state][c], size + 1
                if size < least:
                    continue
                reach = 0
                s = state
                if size >= window:
                    longest = max(longest, size)
                    while length[link[s]] >= window:
                        s = link[s]
                    found |= self.owners[s]
                    reach = window
                for short, k in self.short[state]:
                    if short <= size:
                        found.add(k)
                        reach = max(reach, short)
                if reach:
                    a = i + 1 - reach
                    while spans and spans[-1][1] >= a:  # a long window may reach over several short items' spans
                        a = min(a, spans.pop()[0])
                    spans.append([a, i + 1])
            at = stop + 1
        return [(a, b) for a, b in spans], found, longest


def batches(benchmark: DataFrame, max_words: int) -> Iterator[list[tuple]]:
    """Items (id, words) in batches of at most max_words words, or of one item."""
    group: list[tuple] = []
    held = 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        words = words_of(text)
        if group and held + len(words) > max_words:
            yield group
            group, held = [], 0
        group.append(("" if item is None else item, words))
        held += len(words)
    yield group


def _merged(parts: list[tuple[list[tuple[int, int]], set, int]]) -> tuple[list[tuple[int, int]], set, int]:
    if len(parts) == 1:
        return parts[0]
    spans: list[tuple[int, int]] = []
    for a, b in sorted(s for p in parts for s in p[0]):
        if spans and spans[-1][1] >= a:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans, set().union(*(p[1] for p in parts)), max(p[2] for p in parts)


_SPAN = pa.struct([("first", pa.int64()), ("end", pa.int64())])
_FOUND = pa.schema([("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("spans", pa.list_(_SPAN))])
_FOUND_DDL = "n_words long, items array<string>, longest long, spans array<struct<first: long, end: long>>"


def _scanned(docs: DataFrame, key: str, group: list[tuple], window: int) -> tuple[DataFrame, object]:
    """key and _FOUND of every document against one batch of items, and the broadcast that it needs."""
    shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(group, window))
    schema = pa.schema([(key, pa.int64()), *_FOUND])

    def scan(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in chunks:
            out: list[list] = [[] for _ in schema]
            for row, text in rows_of(batch, key, "text"):
                words = words_of(text)
                spans, items, longest = found.find(words)
                names = sorted({found.ids[k] for k in items})
                for column, value in zip(out, (row, len(words), names, longest, [{"first": a, "end": b} for a, b in spans])):
                    column.append(value)
            yield record(schema, out)

    narrow = docs.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    return map_arrow(narrow, f"`{key}` long, {_FOUND_DDL}", scan), shared


def _leaks(docs: DataFrame, key: str, benchmark: DataFrame, window: int, max_words: int, by_row: bool) -> DataFrame:
    """key and _FOUND of every document. by_row: key tells rows apart, so that finds of several batches can be merged."""
    groups = batches(benchmark, max_words)
    first = next(groups)
    second = next(groups, None)
    if second is None:
        return _scanned(docs, key, first, window)[0]
    if not by_row:
        raise ValueError("a benchmark of several batches needs rows that can be told apart")
    parts = None
    for group in chain([first, second], groups):
        found, shared = _scanned(docs, key, group, window)
        one = written(found, "leaks")
        shared.destroy()
        parts = one if parts is None else parts.unionByName(one)
    schema = pa.schema([(key, pa.int64()), *_FOUND])

    def merge(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks:
            out: list[list] = [[] for _ in schema]
            for row, n_words, some in rows_of(batch, key, "n_words", "some"):
                finds = [([(x["first"], x["end"]) for x in f["spans"]], set(f["items"]), f["longest"]) for f in some]
                spans, items, longest = _merged(finds)
                for column, value in zip(out, (row, n_words, sorted(items), longest, [{"first": a, "end": b} for a, b in spans])):
                    column.append(value)
            yield record(schema, out)

    # a row's finds are one per batch of items
    together = parts.groupBy(key).agg(F.max("n_words").alias("n_words"), F.collect_list(F.struct("items", "longest", "spans")).alias("some"))
    return map_arrow(together, f"`{key}` long, {_FOUND_DDL}", merge)


def _one_batch(benchmark: DataFrame, max_words: int) -> bool:
    groups = batches(benchmark, max_words)
    next(groups)
    return next(groups, None) is None


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), longest match, spans of hit words."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"]).alias("n_hit")
    wanted = ["n_words", hit, "items", "longest", "spans"]
    if _one_batch(benchmark, max_words):
        return _leaks(docs, "doc_id", benchmark, window, max_words, False).select("doc_id", *wanted)
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    numbered = written(numbered, "numbered")  # so that the numbers mean the same rows from here on
    return numbered.select("_row", "doc_id").join(_leaks(numbered, "_row", benchmark, window, max_words, True), "_row").select("doc_id", *wanted)


def digest(leaks: DataFrame) -> DataFrame:
    return leaks.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, max_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """docs without leaked passages: hit spans are cut out of the texts, and documents of which more than max_coverage is
    hit go. Columns stay as they are, n_chars (if there) follows the text."""
    text_at = docs.columns.index("text")
    columns = docs.columns
    if _one_batch(benchmark, max_words):
        shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(next(batches(benchmark, max_words)), window))
        rows, spans_at = docs, None
    else:
        row, spans_name = fresh(docs, "_row", "_spans")
        numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        found = _leaks(numbered, row, benchmark, window, max_words, True).select(row, F.col("spans").alias(spans_name))
        rows = numbered.join(found, row).select(*columns, spans_name)
        shared, spans_at = None, len(columns)

    def cut(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks:
            known = None if spans_at is None else batch.column(spans_at).to_pylist()
            texts, keep = [], []
            for k, text in enumerate(batch.column(text_at).to_pylist()):
                lowered = text.translate(LOWER) if text else ""
                places = [m.span() for m in WORD.finditer(lowered)]
                if known is None:
                    spans = shared.value.find([lowered[a:b] for a, b in places])[0]
                else:
                    spans = [(s["first"], s["end"]) for s in known[k]]
                keep.append(sum(b - a for a, b in spans) <= max_coverage * len(places))
                for a, b in reversed(spans):
                    text = text[: places[a][0]] + text[places[b - 1][1] :]
                texts.append(text)
            out = batch.columns[: len(columns)]
            out[text_at] = pa.array(texts, out[text_at].type)
            if "n_chars" in columns:
                at = columns.index("n_chars")
                out[at] = pa.array([None if t is None else len(t) for t in texts], out[at].type)
            yield pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(keep, pa.bool_()))

    return map_arrow(rows, docs.schema, cut)


def digest_sql(window: int = WINDOW) -> str:
    """The same by plain SQL: windows of items joined with windows of documents."""
    words = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words.format(t="coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {window}) AS k, array_to_string(w[i : i + least(len(w), {window}) - 1], ' ') AS x
  FROM b, range(1, len(w) - least(len(w), {window}) + 2) r(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS x FROM d, ks, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
hits AS (SELECT doc_id, i, dw.k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.x = bw.x),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

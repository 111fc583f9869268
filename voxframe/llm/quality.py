"""Quality rules: a hashed n-gram log-likelihood ratio on top of plain counts.

Two multinomials over hashed word n-grams are counted in one pass over all texts: the raw corpus (every document) and
the trusted target (documents labelled good and not toxic). A document's score is the mean, over its n-grams, of the logarithm of
the ratio of their smoothed probabilities: normalised for length, so long and short texts compare. Every document is
held against one threshold. It is fixed from labelled documents that were not counted: of the cuts that reject at most
``max_loss`` of the trusted ones, one that rejects most of those labelled bad. No document's verdict is left to chance.

All labelled documents are used: by a hash of the doc_id one half of them is counted, the other half sets the threshold.
Labels are never collected. A bitmap of fixed size, of hashes of labelled ids, lets tasks pass over texts that have no
label; what it lets through is then joined with the labels, so the outcome is exact however full the bitmap is. The
threshold is found by counting scores in ever narrower bins.

Base rules: under 50 words, or over half of the words in repeated three-word windows.

Words are ``[^\\x20\\x09-\\x0D]+``, that is, what bytes.split() gives. For the ratio they are cut further, into a mark of
their shape and their letters, so that junk shows however rare its words are.

Defined results: null and empty texts have no words, fail the base rules and score 0; a document without n-grams of
either kind scores 0; repeated rows count and are judged row by row; labels that are missing count for the raw corpus
alone, repeated labels of a doc_id by their smallest quality and largest toxicity; without labelled documents of both
kinds there is no threshold and the base rules decide; other columns are ignored, or kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SIEVE_BITS, bit_of, held, map_arrow, passed, record, rows_of, sieve, sifted, written

#: Buckets of n-gram hashes: a fixed size, whatever the corpus.
BUCKETS = 1 << 16
#: Share of trusted documents that the threshold may cost.
MAX_LOSS = 0.002
#: Bins of a pass over the scores.
BINS = 4096
#: Pseudo-counts per bucket.
PRIOR = 5.0
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"


class _Hasher:
    """Word -> 64-bit hash; the memo is bounded."""

    def __init__(self, limit: int = 300_000):
        self.limit, self.known = limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > self.limit:
                known.clear()
                new = set(words)
            digest = xxhash.xxh64_intdigest
            for w in new:
                known[w] = digest(shape(w), 7)
        return np.array(list(map(known.__getitem__, words)), np.uint64)


def shape(word: bytes) -> bytes:
    """What counts of a word in n-grams: its bytes without sentence marks; upper case and symbols leave a mark."""
    bare = word.rstrip(b".,;:?")
    mark = b""
    if bare.isupper() and len(bare) > 2:
        mark = b"U"
    last = bare[-1:]
    if last and last < b"\x80" and not last.isalnum():
        return mark + b"S" + last * min(3, len(bare) - len(bare.rstrip(last)))
    return mark + bare.lower()


def buckets(words: list[bytes], n: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of a text's words and word pairs."""
    if not words:
        return np.zeros(0, np.int64)
    h = held("quality", _Hasher)(words)
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.concatenate([h >> np.uint64(40), pairs >> np.uint64(40)]).astype(np.int64) % n


def features(text: str | None) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """(words, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words))"""
    if not text:
        return [], (0, 0, 0, 0, 0)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    # code points are the bytes that don't continue one; the six white space bytes are no part of words
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = raw.split(b"\n")
    # a line is white space only if none of its bytes is a word's
    full = [x for x in lines if x and not x.isspace()]
    dup = len(full) - len(set(full))
    return words, (len(words), chars, symbols, dup, repeated_words(words))


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words in windows that are found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    first: dict[tuple, int] = {}
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == n:
        return 0
    hit = bytearray(len(words))
    for i, g in enumerate(grams):
        j = first.setdefault(g, i)
        if j != i:
            hit[i : i + window] = hit[j : j + window] = b"\x01" * window
    return sum(hit)


def labelled(labels: DataFrame) -> DataFrame:
    """id, kind (1 trusted, 0 labelled bad) and half of every labelled document."""
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    kind = F.when((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0), 1).when(F.col("q") == 0, 0)
    return own.select("id", kind.alias("kind"), F.xxhash64("id").bitwiseAND(F.lit(1)).cast("int").alias("half")).where("kind is not null")


class Model:
    """A bucket's log ratio, and the threshold (None: base rules alone)."""

    def __init__(self, ratio: np.ndarray, threshold: float | None):
        self.ratio, self.threshold = ratio, threshold

    def score(self, words: list[bytes]) -> float:
        return float(self.ratio[buckets(words, len(self.ratio))].mean()) if words else 0.0


def cut_at(good: list[float], bad: list[float], max_loss: float) -> float | None:
    """Scores below the cut are rejected: at most max_loss of the good, as many bad as that allows; midway in the gap."""
    if not good or not bad:
        return None
    good, bad = sorted(good), sorted(bad)
    spare = int(max_loss * len(good))
    worst = good[spare]
    caught = [b for b in bad if b < worst]
    return (caught[-1] + worst) / 2 if caught else None


def nth_least(scores: DataFrame, n: int, bins: int = BINS) -> float:
    """The score with n smaller or equal ones before it, by counting: of each pass one row a bin is collected."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    while low < high:
        place = F.least(F.floor((F.col("score") - low) / (high - low) * bins), F.lit(bins - 1))
        inside = scores.where(F.col("score").between(low, high)).groupBy(place.alias("bin"))
        for _, count, least, most in inside.agg(F.count("*"), F.min("score"), F.max("score")).orderBy("bin").collect():
            if n < count:
                low, high = least, most
                break
            n -= count
    return low


def cut_of(scored: DataFrame, max_loss: float) -> float | None:
    """cut_at of any number of scores; scored (kind, score) is read several times: pass a written table."""
    good, bad = scored.where("kind = 1"), scored.where("kind = 0")
    n = good.count()
    if not n:
        return None
    worst = nth_least(good, int(max_loss * n))
    caught = bad.where(F.col("score") < worst).agg(F.max("score")).first()[0]
    return None if caught is None else (caught + worst) / 2


def _counts(docs: DataFrame, n: int) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; each task sends one array of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for (text,) in rows_of(batch, "text"):
                if text:
                    np.add.at(total, buckets(text.encode("utf-8", "surrogatepass").split(), n), 1)
        used = np.flatnonzero(total)
        yield pa.record_batch({"bucket": used, "n": total[used]})

    out = np.zeros(n)
    for b, k in map_arrow(docs.select("text"), "bucket long, n long", count).groupBy("bucket").agg(F.sum("n")).collect():  # n rows at most
        out[b] = k
    return out


def _texts_of(docs: DataFrame, ids: DataFrame, bits: int) -> DataFrame:
    """The rows of docs (doc_id, text) that have one of the ids. Of the others few are shuffled, if any."""
    shared = docs.sparkSession.sparkContext.broadcast(sieve(ids, bits))
    return sifted(docs.where("doc_id is not null"), "doc_id", shared, bits).join(ids, F.col("doc_id") == F.col("id"), "left_semi")


def _scores_of(docs: DataFrame, ids: DataFrame, model: Model, bits: int) -> DataFrame:
    """id, score of the rows of docs that have one of the ids and stand the base rules. No text is shuffled."""
    sc = docs.sparkSession.sparkContext
    shared, own = sc.broadcast(sieve(ids, bits)), sc.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.filter(pa.array(passed(shared.value, batch.column(2))))
            got = [verdict(doc, text, own.value) for doc, text in rows_of(near, "doc_id", "text")]
            yield record(schema, [[v[0] for v in got if not v[6]], [v[7] for v in got if not v[6]]])

    near = docs.where("doc_id is not null").select("doc_id", "text", bit_of("doc_id", bits).alias("bit"))
    return map_arrow(near, "doc_id long, score double", rate).join(ids, F.col("doc_id") == F.col("id")).drop("doc_id")


def fit(docs: DataFrame, labels: DataFrame, n: int = BUCKETS, max_loss: float = MAX_LOSS, bits: int = SIEVE_BITS) -> Model:
    """The raw corpus is counted over all documents, the trusted target over all that are trusted in one half of the
    labelled ones; all of the other half set the cut."""
    known = written(labelled(labels), "labels")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    target = _counts(_texts_of(narrow, known.where("kind = 1 and half = 0").select("id"), bits), n)
    if not target.any():
        return Model(np.zeros(n), None)
    raw = _counts(narrow, n)
    p = (raw + 0.5) / (raw.sum() + 0.5 * n)
    # the target is smoothed towards the raw corpus: without evidence a bucket's ratio is 1
    q = (target + PRIOR * n * p) / (target.sum() + PRIOR * n)
    model = Model(np.log(q) - np.log(p), None)
    model.threshold = cut_of(written(_scores_of(narrow, known.where("half = 1").select("id", "kind"), model, bits), "scores"), max_loss)
    return model


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: the counts, base_failed, score (mean log-likelihood ratio of its n-grams) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), *((x, pa.int64()) for x in names), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [verdict(doc, text, own) for doc, text in rows_of(batch, "doc_id", "text")]
            yield record(schema, [list(c) for c in zip(*out)] if out else [[] for _ in schema])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(narrow, "doc_id long, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, score double, kept boolean", mark)


def verdict(doc: int | None, text: str | None, model: Model) -> tuple:
    words, counts = features(text)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > 50 * counts[0]
    score = model.score(words)
    return (doc, *counts, failed, score, not failed and (model.threshold is None or score >= model.threshold))


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are kept, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([verdict(None, t, own)[-1] for t in texts], pa.bool_()))

    return map_arrow(docs, docs.schema, sift)

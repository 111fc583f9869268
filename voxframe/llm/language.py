"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary. A word's probability in a language is
the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities: a forward algorithm over the
word's lattice, for all languages at once. A text's log-likelihood is the sum over its words; with equal priors its
softmax is the score.

Piece probabilities are fitted by expectation maximisation (forward-backward over the lattices) on a bounded sample: of
each language the first ``per_language`` documents by a hash of doc_id. Only rows with a language take part, and only
those that ``learnable`` admits.

Words are maximal runs of letters of any length, lower-cased, with the vocabulary's word mark in front. A letter outside
the vocabulary counts as one unknown piece. Words of over LONG letters are scored one by one, with scaled sums, and not
learned from.

Defined results: ``und`` with score 0 if a text is null or has no letter, or if there was nothing to learn from; equal
likelihoods go to the language that sorts first; repeated rows count and are scored row by row; rows with a null lang
are only scored; an empty table gives an empty result; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import map_arrow, record, rows_of

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Letters of a word up to which its probabilities are sure to be above the smallest double.
LONG = 40
MARK = "▁"
#: Documents of a language that are learned from, at most.
PER_LANGUAGE = 600
ROUNDS = 5


def vocabulary(path: str) -> dict[str, int]:
    """Pieces of a public sentencepiece vocabulary that are words' parts, numbered from 1; 0 is the unknown letter."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: k for k, p in enumerate((p for p in pieces if p.lstrip(MARK).isalpha() and p.lower() == p or p == MARK), 1)}


class Trie:
    """The vocabulary's pieces letter by letter: edges as sorted numbers (node, letter), looked up many at a time."""

    def __init__(self, vocabulary: dict[str, int]):
        nodes, edges = {"": 0}, []
        for piece in vocabulary:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    edges.append((nodes[piece[: k - 1]] << 21 | ord(piece[k - 1]), nodes[piece[:k]]))
        edges.sort()
        # a last edge that no letter takes, so that every look-up finds some place
        self.keys = np.array([k for k, _ in edges] + [np.iinfo(np.int64).max], np.int64)
        self.child = np.array([c for _, c in edges] + [0], np.int64)
        self.piece = np.zeros(len(nodes), np.int64)
        for piece, number in vocabulary.items():
            self.piece[nodes[piece]] = number

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Nodes reached, 0 where there is no such edge."""
        key = node << 21 | letter
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.child[at], 0)


class Lattice:
    """All piece occurrences in some words of at most LONG letters, ordered for a sweep over end positions."""

    def __init__(self, words: list[str], trie: Trie):
        self.n = len(words)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        self.width = int(sizes.max(initial=0)) + 1
        letters = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(self.n), sizes)
        start = np.arange(len(letters)) - first[word]
        left = sizes[word] - start
        node, at = np.zeros(len(letters), np.int64), np.arange(len(letters))
        found, length = [], 1
        while len(at):  # all places at once, a letter further each time
            node = trie.step(node, letters[at + length - 1])
            piece = trie.piece[node]
            use = (piece > 0) | (length == 1)
            found.append((word[at[use]], start[at[use]], np.full(int(use.sum()), length), piece[use]))
            on = (node > 0) & (left[at] > length)
            node, at = node[on], at[on]
            length += 1
        columns = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (zip(*found) if found else [()] * 4)]
        key = ((columns[1] + columns[2]) * 64 + columns[2]).astype(np.uint16)  # end and length; both are under 64
        order = np.argsort(key, kind="stable")
        self.word, self.start, size, self.piece = (c[order] for c in columns)
        self.end = self.start + size
        cut = np.flatnonzero(np.diff(key[order])) + 1
        #: within a step a word occurs once, as start and end are fixed
        self.steps = [slice(a, b) for a, b in zip([0, *cut], [*cut, len(self.end)])] if len(self.end) else []
        self.last = sizes

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: (pieces, languages) -> (words, positions, languages)"""
        alpha = np.zeros((self.n, self.width, p.shape[1]))
        alpha[:, 0] = 1
        for s in self.steps:
            w = self.word[s]
            alpha[w, self.end[s]] += alpha[w, self.start[s]] * p[self.piece[s]]
        return alpha

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(self.forward(p)[np.arange(self.n), self.last], 1e-290))

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, the words' counts being given; p has one language."""
        alpha = self.forward(p)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.last] = 1
        q = p[:, 0]
        # backwards, steps that end later come first: all that follow a position are done before it
        for s in reversed(self.steps):
            np.add.at(beta, (self.word[s], self.start[s]), beta[self.word[s], self.end[s]] * q[self.piece[s]])
        total = np.maximum(alpha[np.arange(self.n), self.last], 1e-290)
        use = alpha[self.word, self.start] * q[self.piece] * beta[self.word, self.end] / total[self.word] * counts[self.word]
        return np.bincount(self.piece, use, len(q))


def long_word(word: str, vocabulary: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Log-likelihoods of a word of any length: the same sum, with sums that get small scaled up, for each language."""
    text, longest = MARK + word, max(map(len, vocabulary), default=1)
    sums, up = [np.ones(p.shape[1])], np.zeros(p.shape[1])
    for end in range(1, len(text) + 1):
        here = np.zeros(p.shape[1])
        for k, before in enumerate(reversed(sums), 1):
            piece = vocabulary.get(text[end - k : end], 0 if k == 1 else None)
            if piece is not None:
                here += before * p[piece]
        sums = [*sums[-(longest - 1) :], here] if longest > 1 else [here]
        small = here < 1e-100
        if small.any():
            for s in sums:
                s[small] *= 1e100
            up[small] += 100
    return np.log(np.maximum(sums[-1], 1e-290)) - up * np.log(10)


class Model:
    def __init__(self, languages: list[str], vocabulary: dict[str, int], p: np.ndarray, limit: int = 300_000):
        self.languages, self.vocabulary, self.p, self.limit = languages, vocabulary, p, limit
        self.trie = Trie(vocabulary)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)), np.float64)

    def __getstate__(self):
        return (self.languages, self.vocabulary, self.p, self.limit)

    def __setstate__(self, state):
        self.__init__(*state)

    def learn(self, words: set[str]) -> None:
        """Scores of new words go behind those there are; the table is made once, at its largest size."""
        new, at = list(words), len(self.known)
        if at + len(new) > len(self.scores):
            table = np.empty((max(self.limit, at + len(new)), len(self.languages)))
            table[:at] = self.scores[:at]
            self.scores = table
        for a in range(0, len(new), 4096):
            some = new[a : a + 4096]
            self.scores[at + a : at + a + len(some)] = Lattice(some, self.trie).log_likelihood(self.p)
        self.known.update(zip(new, range(at, at + len(new))))

    def predict(self, texts: list[str | None], block: int = 128) -> list[tuple[str, float]]:
        out = []
        for at in range(0, len(texts), block):
            cut = [WORD.findall(t.lower()) if t else [] for t in texts[at : at + block]]
            tall = [[w for w in words if len(w) > LONG] for words in cut]
            if any(tall):
                cut = [[w for w in words if len(w) <= LONG] for words in cut]
            there = set().union(*cut)
            missing = there.difference(self.known)
            if len(self.known) + len(missing) > self.limit:
                missing = there
                self.known.clear()
            if missing and self.languages:
                self.learn(missing)
            for words, long_ones in zip(cut, tall):
                if not self.languages or not any(c.isalpha() for w in (*words, *long_ones) for c in w):
                    out.append((UNKNOWN, 0.0))
                    continue
                total = self.scores[list(map(self.known.__getitem__, words))].sum(0)
                for w in long_ones:
                    total = total + long_word(w, self.vocabulary, self.p)
                best = int(total.argmax())
                out.append((self.languages[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, path: str, learnable: Column | None = None, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """docs: doc_id, text, lang. The sample is chosen on doc_id and lang alone; then only its texts are read."""
    spark = docs.sparkSession
    rows = docs.where("lang is not null and doc_id is not null")
    rows = rows.where(learnable) if learnable is not None else rows
    ids = rows.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("language"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    # a share of each language is enough to rank, so that ranking one language is a small task whatever its size
    sizes = {r[0]: r[1] for r in ids.groupBy("language").count().collect()}
    if not sizes:
        return Model([], {}, np.zeros((1, 0)))
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2 * per_language / n + 50 / n))]), F.col("language"))
    ids = ids.where((F.shiftrightunsigned("h", 11) / float(1 << 53)) <= share)
    ranked = ids.withColumn("_k", F.row_number().over(Window.partitionBy("language").orderBy("h", "id"))).where(F.col("_k") <= per_language)
    chosen = spark.createDataFrame(ranked.select("id", "language").collect(), "id long, language string")  # per_language rows of each
    some = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("language"), F.col("text").cast("string").alias("text"))
    some = some.join(F.broadcast(chosen.distinct()), ["id", "language"], "left_semi").where("text is not null")
    counts: dict[str, Counter] = {k: Counter() for k in sizes}
    for language, text in some.select("language", "text").toLocalIterator():
        counts[language].update(w for w in WORD.findall(text.lower()) if len(w) <= LONG)
    languages = sorted(k for k, c in counts.items() if c)
    pieces = vocabulary(path)
    trie = Trie(pieces)
    columns = []
    for language in languages:
        words = sorted(counts[language])
        blocks = [(Lattice(words[a : a + 8192], trie), np.array([counts[language][w] for w in words[a : a + 8192]], float)) for a in range(0, len(words), 8192)]
        p = np.full((len(pieces) + 1, 1), 1.0 / (len(pieces) + 1))
        for _ in range(rounds):
            use = sum(lattice.expected(p, c) for lattice, c in blocks)
            use = use + 0.01
            p = (use / use.sum())[:, None]
        columns.append(p)
    return Model(languages, pieces, np.concatenate(columns, 1) if columns else np.zeros((1, 0)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Only the text decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = list(rows_of(batch, "doc_id", "held_out", "text"))
            found = own.predict([t for _, _, t in rows])
            yield record(schema, [[r[0] for r in rows], [r[1] for r in rows], [f[0] for f in found], [f[1] for f in found]])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(narrow, "doc_id long, held_out boolean, lang_pred string, score double", guess)


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with a score of at least ``least``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = own.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([language != UNKNOWN and score >= least for language, score in found], pa.bool_()))

    return map_arrow(docs, docs.schema, sift)

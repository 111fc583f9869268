"""SimHash near-duplicates with BK-trees.

A document's fingerprint has bit b set if over half of its shingles' hashes have it. Fingerprints at most ``radius`` bits
apart are linked; linked fingerprints form components.

Sharding. Of four 16-bit blocks, two fingerprints at most two bits apart agree on two blocks or more. Each different
fingerprint goes to six shards, one for each pair of blocks and the 32 bits there. A shard that grew beyond ``shard``
fingerprints is cut further by the 32 bits that are left: in three blocks of them, one agrees again. What is still
larger is dealt into cells: every tree holds at most about ``shard`` fingerprints, and those of the other cells of that
shard are sent to it as queries, once for each pair of cells. No link is lost, nobody holds a whole group, and no tree is
built from all documents.

In a cell a BK-tree (children keyed by their distance to the parent) is searched along the edges whose key lies within
the radius of the query's distance. A cell emits the links that join two of its components, not all pairs. Components
over cells come from alternating star contractions on these links, whose lineage is cut in the shared folder.

``keep_one`` is for whole near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.
Their fingerprints lie up to some 20 bits apart, too far for blocks to agree. There shards come from minimum hashes of
the shingles (8 bands of 3; texts that are 0.8 alike share one with a probability of 0.997, more alike ones more), every
component of a shard has its own BK-tree, searched within COPY_RADIUS bits, and what it finds is held against the true
similarity. A text is compared with a component until the first true copy, so large groups of copies cost little. Bands
that the very same texts share count once.
There texts are moved only where they must be: those that share a band go to its shards, and those that a bitmap of fixed
size cannot tell from dropped rows are joined with these. All others are read, judged and written where they are.

Defined results: null or wordless texts have fingerprint zero and are linked like any other; texts shorter than a shingle
count whole; repeated rows stay and share a component; a null doc_id takes part, but never names a component unless all
its members' are null; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, map_arrow, record, rows_of, sieve, sifted, written

RADIUS = 2
SHINGLE = 3
#: Fingerprints of one tree.
SHARD = 2048
#: Near copies: words of a shingle, least similarity, bits searched, and bands by rows of minimum hashes.
COPY_SHINGLE, COPY_SIMILARITY, COPY_RADIUS = 5, 0.8, 24
BANDS, BAND_ROWS = 8, 3
#: Texts, and bytes of shingle sets, of one cell of near copies.
COPY_CELL, COPY_BYTES = 8192, 1 << 26
PAIRS = list(combinations(range(4), 2))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` lower-cased words, of the whole sequence if it is shorter."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(rows_of(batch, "doc_id", "text"))
            fps = np.array([fingerprint(t, shingle) for _, t in rows], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), pa.array(fps)], schema=schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(narrow, "doc_id long, fp long", make)


class BKTree:
    """Children are keyed by their Hamming distance to the parent. A node: fingerprint, children, what was put there."""

    def __init__(self):
        self.root: list | None = None

    def put(self, x: int, value) -> None:
        """Add x with a value of its own; equal fingerprints share a node."""
        if self.root is None:
            self.root = [x, {}, [value]]
            return
        node = self.root
        while d := (x ^ node[0]).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [x, {}, [value]]
                return
            node = child
        node[2].append(value)

    def near(self, x: int, radius: int) -> Iterator[list]:
        """Nodes within the radius, those that are found first at once."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            d = (x ^ node[0]).bit_count()
            if d <= radius:
                yield node
            todo += [child for k, child in node[1].items() if d - radius <= k <= d + radius]

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = [x, {}]
            return
        node = self.root
        while d := (x ^ node[0]).bit_count():
            child = node[1].get(d)
            if child is None:
                node[1][d] = [x, {}]
                return
            node = child

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (x ^ value).bit_count()
            if d <= radius:
                found.append(value)
            if children:
                for k in range(d - radius, d + radius + 1):
                    child = children.get(k)
                    if child is not None:
                        todo.append(child)
        return found


class _Sets:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _bits(block: int, width: int):
    return F.shiftrightunsigned("fp", block * width).bitwiseAND(F.lit((1 << width) - 1))


def shards(distinct: DataFrame, shard: int = SHARD, radius: int = RADIUS) -> DataFrame:
    """(shard key k, level, fp, n of the shard) with two rows or more per shard. The blocks are made for radius 2."""
    if radius > 2:
        raise ValueError("the sharding is exact for a radius of at most 2")
    sixes = F.array(*[F.struct(F.lit(p).alias("p"), F.shiftleft(_bits(i, 16), 16).bitwiseOR(_bits(j, 16)).alias("k"), F.shiftleft(_bits(a, 16), 16).bitwiseOR(_bits(b, 16)).alias("rest")) for p, (i, j) in enumerate(PAIRS) for a, b in [sorted({0, 1, 2, 3} - {i, j})]])
    first = distinct.select("fp", F.inline(sixes)).select("fp", "p", "k", "rest")
    sizes = first.groupBy("p", "k").agg(F.count("*").alias("n")).where("n > 1")
    first = first.join(sizes, ["p", "k"])
    cold = first.where(F.col("n") <= shard).select("fp", "p", "k", F.lit(-1).alias("q"), F.lit(0).cast("long").alias("k2"), "n")
    part = lambda q, at, width: F.struct(F.lit(q).alias("q"), F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << width) - 1)).alias("k2"))
    hot = first.where(F.col("n") > shard).select("fp", "p", "k", F.inline(F.array(part(0, 0, 11), part(1, 11, 11), part(2, 22, 10))))
    again = hot.groupBy("p", "k", "q", "k2").agg(F.count("*").alias("n")).where("n > 1")
    hot = hot.join(again, ["p", "k", "q", "k2"]).select("fp", "p", "k", "q", "k2", "n")
    return cold.unionByName(hot)


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between different fingerprints that join all components: a forest of each cell's links."""
    cells = F.ceil(F.col("n") / shard).cast("int")
    own = F.pmod(F.xxhash64("fp"), cells).cast("int")
    dealt = shards(distinct, shard, radius).select("fp", "p", "k", "q", "k2", cells.alias("cells"), own.alias("own"))
    # to its own cell as a member of the tree, to the later ones as a query
    dealt = dealt.select("fp", "p", "k", "q", "k2", "own", F.explode(F.sequence("own", F.col("cells") - 1)).alias("cell"))
    dealt = dealt.select(F.xxhash64("p", "k", "q", "k2", "cell").alias("c"), "p", "k", "q", "k2", "cell", (F.col("own") != F.col("cell")).alias("query"), "fp")
    key = ["c", "p", "k", "q", "k2", "cell"]
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, *key).sortWithinPartitions(*key, "query", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    mask = (1 << 64) - 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, sets, out = None, None, None, ([], [])
        alone = None  # most cells have a single member: no tree until there is a second
        for batch in batches:
            for *cell, query, fp in rows_of(batch, *key, "query", "fp"):
                if cell != now:
                    now, alone, tree = cell, fp & mask, None
                    first_is_query = query
                    continue
                if tree is None:
                    if first_is_query:  # no member in this cell
                        continue
                    tree, sets = BKTree(), _Sets()
                    tree.add(alone)
                x = fp & mask
                for y in tree.within(x, radius):
                    if sets.join(x, y):
                        out[0].append(min(x, y))
                        out[1].append(max(x, y))
                if not query:
                    tree.add(x)
            if out[0]:
                yield record(schema, [np.array(c, np.uint64).view(np.int64) for c in out])
                out = ([], [])

    return dealt.mapInArrow(search, "a long, b long")


def _mark(edges: DataFrame) -> tuple:
    """What two sets of different edges have in common only if they are the same: their number and two sums of hashes."""
    h = F.xxhash64("u", "v")
    parts = [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1))]
    return tuple(edges.agg(F.count("*"), *map(F.sum, parts), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): alternating large and small stars until nothing changes."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _mark(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, "links")
        after = _mark(new)
        if after == before:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        edges, before = new, after
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable) for every row of docs."""
    marked = written(fingerprints(docs, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius, shard))
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least")
    names = joined.groupBy("root").agg(F.min("least").alias("name"))
    moved = written(joined.join(names, "root").select("fp", "name"), "components")
    # written, so that the last join is between two plain shuffles, of which Spark splits a hot fingerprint's
    named = written(distinct.join(moved, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id")), "names")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- near copies -------------------------------------------------------------------------------------------------------

_MULTIPLIERS = np.random.default_rng(97).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit number per band: a hash of its minimum hashes."""
    import xxhash

    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            least = np.minimum(least, (hashes[at : at + 4096, None] * _MULTIPLIERS).min(0))
    digests = [xxhash.xxh64_intdigest(least[k : k + BAND_ROWS].tobytes(), k) for k in range(0, len(least), BAND_ROWS)]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of different numbers."""
    small, large = sorted((a, b), key=len)
    if len(small) < COPY_SIMILARITY * len(large) or not len(large):
        return float(len(a) == len(b))  # sizes that differ so much cannot be similar enough; none and none are the same
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both / (len(a) + len(b) - both)


class Copies:
    """Components of near copies, each with a BK-tree of fingerprints; add() gives the links that join components."""

    def __init__(self, radius: int, similarity: float):
        self.radius, self.similarity = radius, similarity
        self.trees: list[BKTree] = []
        self.held: list[list[tuple[int, int, np.ndarray]]] = []

    def _copy_in(self, k: int, fp: int, shingles: np.ndarray) -> int | None:
        for node in self.trees[k].near(fp, self.radius):
            for row, own in node[2]:
                if jaccard(own, shingles) >= self.similarity:
                    return row
        return None

    def add(self, row: int, fp: int, shingles: np.ndarray, query: bool) -> list[tuple[int, int]]:
        found = [(k, other) for k in range(len(self.trees)) if (other := self._copy_in(k, fp, shingles)) is not None]
        joined = [k for k, _ in found]
        if query and len(joined) < 2:
            return [(row, other) for _, other in found]
        into = max(joined, key=lambda k: len(self.held[k]), default=None)
        if into is None:
            into = len(self.trees)
            self.trees.append(BKTree())
            self.held.append([])
        moved = [x for k in joined if k != into for x in self.held[k]] + ([] if query else [(row, fp, shingles)])
        for r, f, s in moved:
            self.trees[into].put(f, (r, s))
        self.held[into] += moved
        for k in sorted((k for k in joined if k != into), reverse=True):
            del self.trees[k], self.held[k]
        return [(row, other) for _, other in found]


def copy_links(marks: DataFrame, texts: DataFrame, radius: int, similarity: float, cell: int = COPY_CELL, cell_bytes: int = COPY_BYTES) -> DataFrame:
    """Links (a, b) that join all components of marks (id, fp, bands, n_shingles); texts: id, text of these and others."""
    spark = marks.sparkSession
    members = marks.select("id", "fp", "n_shingles", F.posexplode("bands").alias("band", "k"))
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "id")).alias(name) for seed, name in ((1, "x"), (2, "y"))]
    sizes = members.groupBy("band", "k").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("words"), *same).where("n > 1")
    # of bands that the very same texts share, one finds their links
    sizes = sizes.groupBy("n", "words", "x", "y").agg(F.min(F.struct("band", "k")).alias("at")).select("at.band", "at.k", "n", "words")
    cells = F.greatest(F.ceil(F.col("n") / cell), F.ceil(F.col("words") * 8 / cell_bytes)).cast("int")
    # merge joins: what is joined grows with the corpus, and so the plan is the same at all sizes
    shared = members.select("id", "fp", "band", "k").join(sizes.hint("merge"), ["band", "k"]).select("id", "fp", "band", "k", cells.alias("cells"))
    shared = written(shared.groupBy("id", "fp").agg(F.collect_list(F.struct("band", "k", "cells")).alias("at")), "shared")  # BANDS at most
    # only texts that share a band with another one are moved
    some = sifted(texts.select("id", "text"), "id", spark.sparkContext.broadcast(sieve(shared.select("id"))))
    dealt = some.join(shared.hint("merge"), "id").select("id", "fp", "text", F.inline("at"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    # to its own cell as a member, to the later ones of its shard as a query
    dealt = dealt.withColumn("cell", F.explode(F.sequence("own", F.col("cells") - 1)))
    dealt = dealt.select("band", "k", "cell", (F.col("own") != F.col("cell")).alias("query"), "id", "fp", "text")
    key = ["band", "k", "cell"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, *key).sortWithinPartitions(*key, "query", "id")
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    mask = (1 << 64) - 1

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, copies, out = None, None, []
        for batch in batches:
            for *place, query, row, fp, text in rows_of(batch, *key, "query", "id", "fp", "text"):
                if place != now:
                    now, copies = place, Copies(radius, similarity)
                out += copies.add(row, fp & mask, np.unique(shingle_hashes(text, COPY_SHINGLE)), query)
            if out:
                yield record(pairs, [list(c) for c in zip(*out)])
                out = []

    return map_arrow(dealt, "a long, b long", search)


def keep_one(docs: DataFrame, radius: int = COPY_RADIUS, similarity: float = COPY_SIMILARITY, cell: int = COPY_CELL) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest doc_id, of rows that share it any one.

    Rows are told apart by a number of their own: unlinked texts stay, whatever their doc_id. A row without doc_id stays
    only if all of its group have none.
    """
    spark = docs.sparkSession
    row, fp, bands, words, same = fresh(docs, "_row", "_fp", "_bands", "_words", "_same")
    added = [(fp, pa.int64()), (bands, pa.list_(pa.int64())), (words, pa.int64()), (same, pa.binary())]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                hashes = shingle_hashes(text, COPY_SHINGLE)
                said = b" ".join(text.encode("utf-8", "surrogatepass").lower().split()) if text else b""
                fpv = np.array([majority(hashes)], np.uint64).view(np.int64)[0]
                for column, value in zip(out, (fpv, band_keys(hashes), len(hashes), hashlib.blake2b(said, digest_size=16).digest())):
                    column.append(value)
            columns = [*batch.columns, *(pa.array(c, kind) for c, (_, kind) in zip(out, added))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(name for name, _ in added)])

    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    more = [(fp, "bigint"), (bands, "array<bigint>"), (words, "bigint"), (same, "binary")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema) + "".join(f", `{n}` {t}" for n, t in more)
    # written with its numbers, so that they mean the same rows from here on
    marked = written(map_arrow(numbered, types, mark), "marked")
    doc = F.col("doc_id").cast("long")
    rank = F.struct(doc.isNull().alias("none"), doc.alias("doc"), F.col(row).alias("row"))
    reps = marked.groupBy(same).agg(F.min(rank).alias("r"), F.first(fp).alias("fp"), F.first(bands).alias("bands"), F.first(words).alias("n_shingles"))
    reps = written(reps.select(F.col("r.row").alias("id"), "r", "fp", "bands", "n_shingles"), "texts")
    texts = marked.select(F.col(row).alias("id"), F.col("text").cast("string").alias("text"))
    roots = written(components(copy_links(reps.where("n_shingles > 0"), texts, radius, similarity, cell)), "roots")
    linked = reps.select("id", "r").join(roots, F.col("id") == F.col("node")).groupBy("root").agg(F.min("r").alias("r"))
    alone = reps.select("id").join(roots.select(F.col("node").alias("id")), "id", "left_anti")
    kept = written(alone.unionByName(linked.select(F.col("r.row").alias("id"))).select(F.col("id").alias(row)), "kept")
    dropped = written(marked.select(row).join(kept, row, "left_anti"), "dropped")
    bitmap = spark.sparkContext.broadcast(sieve(dropped))
    rows = marked.select(row, *docs.columns)
    doubtful = sifted(rows, row, bitmap).join(dropped.hint("merge"), row, "left_anti")
    return sifted(rows, row, bitmap, inside=False).unionByName(doubtful).select(*docs.columns)

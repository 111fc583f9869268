"""Best-fit packing with Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. How pieces are packed depends on their lengths alone, so the bin
packing instance is the histogram of lengths: at most ``capacity`` counts, whatever the number of documents. On it

1. the reduction fixes small sets of items that dominate every other set holding their largest item, and removes them;
2. best-fit decreasing packs what is left, handling all items of a length at once.

The outcome is a table of slots: "the items of length L ranked lo..hi-1 lie in sequences s, s+1, ... at offset o". Pieces
then get ranks among those of their length and look their slot up. Ranks come from salted groups and prefix sums, so a
length that holds a third of all pieces is no single task's work. Token ids are not kept or shuffled.

Defined results: a null text is empty, its piece is the end id alone; equal rows are packed as separate documents; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokenization
from ._common import fresh, map_arrow, record, rows_of, written

CAPACITY = 4096
#: Groups per length for ranking, at least, and the rows that a group is to have at most.
SALTS, GROUP_ROWS = 256, 200_000


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, leading_space: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenization.memo(vocabulary, leading_space).encode_all
        for batch in batches:
            rows = list(rows_of(batch, "doc_id", "text"))
            out: list[list] = [[], [], [], [], []]
            for (doc, _), ids in zip(rows, encode([t for _, t in rows])):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc, k, at // 4, len(one) // 4, zlib.crc32(one))):
                        column.append(value)
            yield record(schema, out)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(narrow, "doc_id long, piece int, start long, length long, ids_crc32 long", cut)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], list[tuple[tuple[int, ...], int]]]:
    """Martello and Toth's reduction on a histogram: (what is left, [(set of lengths, how often it was fixed)]).

    For the largest item j of a set, a set F with j is fixed if it dominates all feasible sets with j, that is, if the
    other items of any such set can be put in place of items of F:

    * j alone, if not even the smallest item fits beside it;
    * {j, b} with b the largest that fits, if it fills the bin or if no two items fit beside j;
    * {j, b} if at most two items fit beside j and no pair of them is longer than b;
    * {j, b, c} if at most two fit, b is as above, c is the largest that fits beside j and b, and no pair beside j has
      both items longer than c.
    """
    left = dict(counts)
    lengths = sorted(x for x, n in left.items() if n)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(group: tuple[int, ...]) -> None:
        need = {x: group.count(x) for x in group}
        n = min(left[x] // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= k * n
            if not left[x]:
                lengths.pop(bisect_left(lengths, x))
        fixed.append((group, n))

    def items(without: tuple[int, ...], least: int = 0) -> Iterator[int]:
        """Up to three of the smallest items longer than least, each as often as it is there."""
        given = 0
        for x in lengths[bisect_right(lengths, least) :]:
            for _ in range(min(3, left[x] - without.count(x))):
                yield x
                given += 1
                if given == 3:
                    return

    def largest(room: int, without: tuple[int, ...]) -> int | None:
        at = bisect_right(lengths, room)
        while at:
            at -= 1
            if left[lengths[at]] > without.count(lengths[at]):
                return lengths[at]
        return None

    def dominating(j: int) -> tuple[int, ...] | None:
        room = capacity - j
        b = largest(room, (j,))
        if b is None:
            return (j,)
        small = list(items((j,)))
        if b == room or len(small) < 2 or small[0] + small[1] > room:
            return (j, b)
        if len(small) == 3 and sum(small) <= room:
            return None
        pair = 0
        for x in lengths[: bisect_right(lengths, room)]:
            if left[x] > (j,).count(x):
                y = largest(room - x, (j, x))
                pair = max(pair, x + y if y is not None else 0)
        if pair <= b:
            return (j, b)
        c = largest(room - b, (j, b))
        if c is not None:
            longer = list(items((j,), c))[:2]
            if len(longer) < 2 or sum(longer) > room:
                return tuple(sorted((j, b, c), reverse=True))
        return None

    changed = True
    while changed:
        changed = False
        for j in sorted(lengths, reverse=True):
            while left[j] and (group := dominating(j)):
                take(group)
                changed = True
    return {x: n for x, n in left.items() if n}, fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best-fit decreasing on a histogram: [(((length, how many of it), ...), number of such bins)]."""
    open_bins: dict[int, list[tuple[tuple, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((pattern, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                room, pattern, bins = capacity, (), n
            each = min(room // length, n)  # after one, the same bin is the tightest again
            use = min(bins, n // each)
            if bins > use and pattern:
                put(room, pattern, bins - use)
            put(room - each * length, (*pattern, (length, each)), use)
            n -= use * each
    return [x for room in rooms for x in open_bins[room]]


def slots(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, lo, first sequence, items of it per sequence, offset), by length and lo."""
    rest, fixed = reduce_dominated(counts, capacity)
    patterns = [(tuple((x, group.count(x)) for x in dict.fromkeys(group)), n) for group, n in fixed] + best_fit(rest, capacity)
    used, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for pattern, n in patterns:
        offset = 0
        for length, each in pattern:
            rows.append((length, used[length], sequence, each, offset))
            used[length] += each * n
            offset += each * length
        sequence += n
    assert used == {x: n for x, n in counts.items()}, "every piece has its place"
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(parts: DataFrame, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """parts (with doc_id, piece, length, ids_crc32) plus sequence_id and offset. parts is read twice: pass a written table."""
    spark = parts.sparkSession
    rows = parts.groupBy("length").agg(F.count("*").alias("n")).collect()  # capacity rows at most
    histogram = {int(r[0]): int(r[1]) for r in rows}
    salts = max(salts, -(-max(histogram.values(), default=0) // GROUP_ROWS))
    salt, k, rank, base = fresh(parts, "_salt", "_k", "_rank", "_base")
    salted = parts.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", salt).agg(F.count("*").alias("_n"))
    places = spark.sparkContext.broadcast(slots(histogram, capacity))  # bounded by the number of lengths, not of documents
    before = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", salt, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base))
    local = Window.partitionBy("length", salt).orderBy("doc_id", "piece")
    ranked = salted.withColumn(k, F.row_number().over(local) - 1).join(bases, ["length", salt])
    ranked = ranked.select(*parts.columns, (F.col(base) + F.col(k)).alias(rank))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        step = 1 << 48
        keys = table[:, 0] * step + table[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy().astype(np.int64)
            ranks = batch.column(batch.num_columns - 1).to_numpy().astype(np.int64)
            row = table[np.searchsorted(keys, length * step + ranks, "right") - 1]
            nth = ranks - row[:, 1]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*kept, pa.array(row[:, 2] + nth // row[:, 3]), pa.array(row[:, 4] + nth % row[:, 3] * length)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    return pack(written(pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)

"""Segment operators in which each step depends on what was kept so far.

``ordered_fold`` deals rows to tasks by key, sorts them inside the tasks and streams them through a state machine, so a
group of any length is folded with the few segments that can still change held in memory. The fold of one group is
sequential by definition; groups are independent.

A state machine has push(row) and close(), both giving finished rows. Rows are dicts of the input's columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxframe.functions import fixed_values as V
from voxframe.functions import plain


def ordered_fold(df: DataFrame, keys: list[str], order: list[Column | str], machine: Callable[[], object], schema: str | None = None) -> DataFrame:
    """machine() makes the state of one group. schema: of the result, where it differs from df's."""
    result = StructType.fromDDL(schema) if schema else df.schema
    names, target = df.columns, to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if state is None or own != key:
                    if state is not None:
                        out += state.close()
                    key, state = own, machine()
                out += state.push(row)
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema=target)
                out = []
        if state is not None:
            out += state.close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    dealt = df.select(*names).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, result)


class Deduplicate:
    """Drops a segment that repeats or is part of one kept within the tolerance and overlapping in time; one that holds a
    kept one takes its place, over both spans."""

    def __init__(self, seconds: float = V.DEDUP_SECONDS):
        self.seconds, self.kept = seconds, []

    def push(self, row: dict) -> list[dict]:
        form = plain.dedup_form(row["text"])
        if not form:
            return []
        done = []
        while self.kept and row["start"] - self.kept[0][0]["start"] > self.seconds:
            done.append(self.kept.pop(0)[0])
        for held in reversed(self.kept):
            old, old_form = held
            if row["end"] <= old["start"] or row["start"] >= old["end"]:
                continue
            if form in old_form:
                return done
            if old_form in form:
                old |= {"start": min(old["start"], row["start"]), "end": max(old["end"], row["end"]), "text": row["text"]}
                held[1] = form
                return done
        self.kept.append([dict(row), form])
        return done

    def close(self) -> list[dict]:
        return [row for row, _ in self.kept]


class _Last:
    """A fold that may still change the last segment only."""

    def __init__(self):
        self.last: dict | None = None

    def push(self, row: dict) -> list[dict]:
        if self.last is None:
            self.last = dict(row)
            return []
        new = self.step(self.last, row)
        if new is None:
            return []
        done, self.last = self.last, new
        return [done]

    def close(self) -> list[dict]:
        return [self.last] if self.last is not None else []

    def step(self, last: dict, row: dict) -> dict | None:
        raise NotImplementedError


def _appended(last: dict, row: dict, shared: int) -> None:
    """The words of row after the first ``shared`` go to the end of last."""
    rest = " ".join(row["text"].split()[shared:])
    if rest:
        last["text"] = f"{last['text']} {rest}".strip()


class MergeOverlapping(_Last):
    """Segments that begin before the last one ends: shared words are said once, parts vanish, others move behind it."""

    def step(self, last: dict, row: dict) -> dict | None:
        if row["start"] > last["end"]:
            return dict(row)
        shared = plain.overlap(last["text"], row["text"])
        if shared:
            _appended(last, row, shared)
        elif plain.contained(row["text"], last["text"]):
            pass
        elif plain.contained(last["text"], row["text"]):
            last |= {"text": row["text"], "start": min(last["start"], row["start"])}
        else:
            start = round(last["end"] + 0.001, 3)
            return row | {"start": start, "end": row["end"] if start < row["end"] else round(start + 0.001, 3)}
        last["end"] = max(last["end"], row["end"])
        return None


class StripBoundary(_Last):
    """After a text that ends in spelled letters, a capitalised word at the start of the next one goes."""

    def step(self, last: dict, row: dict) -> dict:
        return row | {"text": plain.after_capitals(row["text"])} if plain.ends_spelled(last["text"]) else dict(row)


def should_merge(last: dict, row: dict) -> bool:
    """Whether a segment continues the one before it."""
    a, b = last["text"].strip(), row["text"].strip()
    if row["start"] - last["end"] > V.MERGE_GAP_SECONDS or not a or not b:
        return False
    if len(a.split()) + len(b.split()) > V.MERGED_WORDS:
        return False
    continues = plain.starts_lower(b) or len(b.split()) <= V.CONTINUATION_WORDS
    if a.endswith("?") and not continues:
        return False
    return continues or plain.overlap(a, b) >= 2 or plain.contained(b, a) or plain.contained(a, b)


def tail_replaced(a: str, b: str) -> str | None:
    """a up to the last place, among its last eight words, where b's first four to two words stand, and then b."""
    left, right = a.split(), b.split()
    if len(left) < 3 or not 2 <= len(right) <= 8:
        return None
    keys, wanted = plain.word_keys(left), plain.word_keys(right)
    for n in range(min(4, len(right), len(left)), 1, -1):
        places = [i for i in range(max(0, len(left) - 8), len(left) - n + 1) if keys[i : i + n] == wanted[:n]]
        if places:
            return " ".join(left[: places[-1]] + right)
    return None


class MergeAdjacent(_Last):
    """Continuations are joined to the segment before them."""

    def step(self, last: dict, row: dict) -> dict | None:
        if not should_merge(last, row):
            return dict(row)
        shared = plain.overlap(last["text"], row["text"])
        if shared and not last["text"].strip().endswith("?"):
            _appended(last, row, shared)
        elif plain.contained(row["text"], last["text"]):
            pass
        elif plain.contained(last["text"], row["text"]):
            last["text"] = row["text"]
        else:
            last["text"] = tail_replaced(last["text"], row["text"]) or f"{last['text']} {row['text']}".strip()
        last["end"] = max(last["end"], row["end"])
        return None


class TrimBoundary:
    """Words that end the segment kept before are cut from the start of the next; what is then empty goes."""

    def __init__(self, most: int = V.BOUNDARY_WORDS):
        self.most, self.before = most, None

    def push(self, row: dict) -> list[dict]:
        text = row["text"]
        if not text:
            return []
        if self.before:
            words = text.split()
            k = plain.common_edge(plain.word_keys(self.before.split()), plain.word_keys(words), self.most)
            text = " ".join(words[k:]) if k else text
        if not text:
            return []
        self.before = text
        return [row | {"text": text}]

    def close(self) -> list[dict]:
        return []


class CrossChannel:
    """In rows of one normalised text: one that overlaps a kept one of another speaker, begun within a second, goes."""

    def __init__(self, seconds: float = V.CHANNEL_DEDUP_SECONDS):
        self.seconds, self.kept = seconds, []

    def push(self, row: dict) -> list[dict]:
        self.kept = [k for k in self.kept if row["start"] - k["start"] <= self.seconds]
        if any(row["end"] >= k["start"] and row["start"] <= k["end"] and row["speaker"] != k["speaker"] for k in self.kept):
            return []
        self.kept.append(row)
        return [row]

    def close(self) -> list[dict]:
        return []


class PackWindows:
    """Speech windows, in order of start, packed into chunks of at most ``seconds``; longer ones are cut."""

    def __init__(self, seconds: float):
        self.seconds, self.now, self.keys = seconds, None, {}

    def _chunk(self, start: float, end: float) -> dict:
        return self.keys | {"start": start, "end": end}

    def push(self, row: dict) -> list[dict]:
        self.keys = {k: v for k, v in row.items() if k not in ("start", "end", "duration")}
        start, end = max(0.0, row["start"]), min(row["duration"], row["end"])
        done = []
        if end <= start:
            return done
        if self.now is None:
            self.now = (start, end)
        elif end - self.now[0] <= self.seconds:
            self.now = (self.now[0], max(self.now[1], end))
        else:
            done.append(self._chunk(*self.now))
            self.now = (start, end)
        while self.now[1] - self.now[0] > self.seconds:
            cut = self.now[0] + self.seconds
            done.append(self._chunk(self.now[0], cut))
            self.now = (cut, self.now[1])
        return done

    def close(self) -> list[dict]:
        return [self._chunk(*self.now)] if self.now and self.now[1] > self.now[0] else []


ORDER = ["start", "end", "seq"]


def deduplicate(segments: DataFrame, keys: list[str], seconds: float = V.DEDUP_SECONDS) -> DataFrame:
    return ordered_fold(segments, keys, ORDER, lambda: Deduplicate(seconds))


def merge_overlapping(segments: DataFrame, keys: list[str]) -> DataFrame:
    return ordered_fold(segments, keys, ORDER, MergeOverlapping)


def strip_boundaries(segments: DataFrame, keys: list[str]) -> DataFrame:
    return ordered_fold(segments, keys, ORDER, StripBoundary)


def merge_adjacent(segments: DataFrame, keys: list[str]) -> DataFrame:
    return ordered_fold(segments, keys, ORDER, MergeAdjacent)


def trim_boundaries(segments: DataFrame, keys: list[str], most: int = V.BOUNDARY_WORDS) -> DataFrame:
    return ordered_fold(segments, keys, ["seq"], lambda: TrimBoundary(most))


class Chain:
    """Several folds of the same rows and order in one pass: what one finishes, the next is given."""

    def __init__(self, *machines):
        self.machines = [m() for m in machines]

    def _through(self, rows: list[dict], at: int) -> list[dict]:
        for m in self.machines[at:]:
            rows = [x for row in rows for x in m.push(row)]
        return rows

    def push(self, row: dict) -> list[dict]:
        return self._through([row], 0)

    def close(self) -> list[dict]:
        out = []
        for k, m in enumerate(self.machines):
            out += self._through(m.close(), k + 1)
        return out


def postprocess(segments: DataFrame, keys: list[str], seconds: float = V.DEDUP_SECONDS) -> DataFrame:
    """Deduplicate, merge overlapping, strip boundaries, merge adjacent: one shuffle and one pass."""
    return ordered_fold(segments, keys, ORDER, lambda: Chain(lambda: Deduplicate(seconds), MergeOverlapping, StripBoundary, MergeAdjacent))


def cross_channel(segments: DataFrame, recording: str = "recording", seconds: float = V.CHANNEL_DEDUP_SECONDS) -> DataFrame:
    """Union of channels without what both heard. Only equal texts meet, so they are what rows are dealt by."""
    from voxframe.functions.text import normalize_for_dedup

    marked = segments.withColumn("_norm", normalize_for_dedup(F.col("text"))).where("_norm <> ''")
    return ordered_fold(marked, [recording, "_norm"], ORDER, lambda: CrossChannel(seconds)).drop("_norm")


def pack_windows(windows: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """windows: keys, start, end, duration (of the recording) -> chunks."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema if f.name != "duration")
    return ordered_fold(windows, keys, ["start", "end"], lambda: PackWindows(seconds), schema)

"""Token-ID files: flat unsigned integers plus 64-bit document offsets, read back through memory maps.

A data set is a folder in the shared store. Every part holds one range of doc_id in ascending order:

* ``NAME.bin`` - token ids of all its documents in a row, of 16 or 32 bits (ids that do not fit are an error);
* ``NAME.off`` - 64-bit offsets (in ids, from the part's first id) of its documents, and the part's end;
* ``NAME.doc`` - 64-bit doc_ids in the same order.

The manifest (a table of part, name, n_docs, n_ids) is written once all parts are there; parts' bases, the number of ids
in all parts before, are prefix sums over it. A repeated task writes another NAME, and only names that a finished task
reported get into the manifest, so lost executors leave at most unused files.

Defined results: a null text counts as empty (its end id alone); rows with a null doc_id come first; rows with equal
doc_id are ordered by text; every input row is kept; an empty table gives an empty data set; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokenization
from ._common import map_arrow, rows_of, shared_folder, written

#: doc_id of rows that have none, in the .doc file.
NO_DOC = -(2**63)


def _file_system(uri: str):
    """The store of a folder and the path in it; None for folders that this machine has mounted."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return None, parsed.path
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Sink:
    """One file of the shared store, written as a stream. On mounted folders it gets its name when it is whole."""

    def __init__(self, folder: str, name: str):
        store, path = _file_system(folder)
        self.path = f"{path}/{name}"
        self.mounted = store is None
        if self.mounted:
            os.makedirs(path, exist_ok=True)
        else:
            store.create_dir(path, recursive=True)
        self.out = open(f"{self.path}.part", "wb") if self.mounted else store.open_output_stream(self.path)
        self.write = self.out.write

    def close(self) -> None:
        self.out.close()
        if self.mounted:
            os.replace(f"{self.path}.part", self.path)


def open_map(folder: str, name: str, dtype: str) -> np.ndarray:
    """A memory map of one file. Of a remote store's file, a nameless copy is mapped that goes with the map."""
    store, path = _file_system(folder)
    path = f"{path}/{name}"
    if store is None:
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    copy = tempfile.TemporaryFile()
    with store.open_input_stream(path) as source:
        while chunk := source.read(1 << 22):
            copy.write(chunk)
    copy.flush()
    return np.memmap(copy, dtype, "r") if copy.tell() else np.zeros(0, dtype)


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str, leading_space: bool = True, id_bits: int = 16, partitions: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) into a data set in folder; returns its manifest with each part's base.

    The one shuffle is the range partitioning that puts documents in order; ids of a part go straight to its file.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dtype = {16: "<u2", 32: "<u4"}[id_bits]
    if max(end_id, *tokenization.load(vocabulary).get_vocab().values()) >> id_bits:
        raise ValueError(f"{vocabulary} has ids of over {id_bits} bits")
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # by a text's beginning too, so that rows that share a doc_id, or have none, are many parts
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.substring(F.coalesce("text", F.lit("")), 1, 64))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))
    )
    end = np.array([end_id], dtype).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        encode = tokenization.memo(vocabulary, leading_space, dtype).encode_all
        n_docs = n_ids = 0
        sinks: list[_Sink] = []
        for batch in batches:
            rows = list(rows_of(batch, "doc_id", "text"))
            if not rows:
                continue
            sinks = sinks or [_Sink(folder, f"{name}.{kind}") for kind in ("bin", "off", "doc")]
            got = encode([t for _, t in rows])
            lengths = np.array([len(x) // (id_bits // 8) + 1 for x in got], np.int64)
            sinks[0].write(end.join([*got, b""]))
            sinks[1].write((n_ids + np.cumsum(lengths) - lengths).astype("<i8").tobytes())
            sinks[2].write(np.array([NO_DOC if d is None else d for d, _ in rows], "<i8").tobytes())
            n_docs, n_ids = n_docs + len(rows), n_ids + int(lengths.sum())
        if sinks:
            sinks[1].write(np.array([n_ids], "<i8").tobytes())
        for sink in sinks:
            sink.close()
        if n_docs:
            yield pa.record_batch({"part": [part], "name": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    # one row a part: written, so that no part is encoded again when the manifest is read
    manifest = written(map_arrow(ordered, "part long, name string, n_docs long, n_ids long", write), "manifest")
    # prefix sums in two levels of 1,024 parts, so that no task gets all of them
    manifest = manifest.withColumn("block", F.floor(F.col("part") / 1024))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = manifest.groupBy("block").agg(F.sum("n_ids").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("_in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(blocks, "block").select("part", "name", "n_docs", "n_ids", (F.col("_base") + F.col("_in")).alias("base"))


def read_token_files(manifest: DataFrame, folder: str, id_bits: int = 16, block: int = 1 << 20) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the crc32 of its ids as 32-bit little-endian integers."""
    dtype = {16: "<u2", 32: "<u4"}[id_bits]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in rows_of(batch, "name", "base"):
                ids, offsets, docs = open_map(folder, f"{name}.bin", dtype), open_map(folder, f"{name}.off", "<i8"), open_map(folder, f"{name}.doc", "<i8")
                for at in range(0, len(docs), 8192):
                    edge = offsets[at : at + 8193].astype(np.int64)
                    crcs = []
                    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                        crc = 0
                        for x in range(a, b, block):  # a very long document is read in blocks
                            crc = zlib.crc32(ids[x : min(b, x + block)].astype("<u4"), crc)
                        crcs.append(crc)
                    own = docs[at : at + 8192]
                    yield pa.record_batch([pa.array(own, mask=np.asarray(own == NO_DOC)), pa.array(base + edge[:-1]), pa.array(np.diff(edge)), pa.array(crcs, pa.int64())], schema=schema)

    parts = manifest.select("part", "name", "base")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(parts.repartition(n, "part"), "doc_id long, start long, n_tokens long, ids_crc32 long", read)


def token_file_digest(docs: DataFrame, vocabulary: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, vocabulary, end_id, folder), folder)

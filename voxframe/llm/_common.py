"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch. Texts are long, so a batch of the default 10,000 rows could fill a worker's memory.
BATCH_ROWS = 512
#: Bits of a bitmap that keeps texts out of joins (4 MB), whatever the number of ids.
SIEVE_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, the one place that driver and executors share.

    Only where the setting is missing and the master is local (unit tests) is one set here.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="voxframe-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/voxframe-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the files are only scratch
        pass


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. It survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: dict = {}


def held(key, make: Callable):
    """What a Python worker keeps between tasks, made when it is first asked for. Workers go from one operator's tasks to
    another's: of these memos one is held at a time, so that they do not add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Python rows of the named columns, a batch at a time."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def map_arrow(df: DataFrame, schema: str, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def record(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df has no column of, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def bit_of(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def sieve(ids: DataFrame, bits: int = SIEVE_BITS) -> np.ndarray:
    """A bitmap of the hashes of ids (one column), in 64-bit words: bits / 64 rows at most are collected."""
    words = ids.select(bit_of(ids.columns[0], bits).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    rows = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(-(-bits // 64), np.uint64)
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return out


def passed(bitmap: np.ndarray, bit: pa.Array) -> np.ndarray:
    at = bit.to_numpy(zero_copy_only=False).astype(np.int64)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def sifted(df: DataFrame, key: str, bitmap, bits: int = SIEVE_BITS, inside: bool = True) -> DataFrame:
    """Rows of df that a broadcast sieve lets through: all that have one of its ids, and some others. Or the rest."""
    (bit,) = fresh(df, "_bit")
    last = len(df.columns)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passed(bitmap.value, batch.column(last)) == inside)).select(range(last))

    return map_arrow(df.withColumn(bit, bit_of(key, bits)), df.schema, sift)

"""Arrow UDFs that can be defined where there is no session yet, and batches that fit large rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _lazy(make: Callable, returns: str, once: bool) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns) -> Column:
            udf = make(f, returns)
            return (udf.asNondeterministic() if once else udf)(*columns)

        return call

    return wrap


def pandas_udf(returns: str, once: bool = False) -> Callable[[Callable], Callable[..., Column]]:
    """Like Spark's decorator, but the result type's text is parsed at the first use.

    once: Spark may not copy the call, as it otherwise does into each filter it infers from what the result is used for.
    """
    return _lazy(F.pandas_udf, returns, once)


def arrow_udf(returns: str, once: bool = False) -> Callable[[Callable], Callable[..., Column]]:
    """The same for functions of Arrow arrays."""
    return _lazy(F.arrow_udf, returns, once)


def bounded(spark: SparkSession, rows: int = 64) -> None:
    """Arrow batches of at most ``rows``: rows here hold whole recordings or files. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) not in range(1, rows + 1):
        spark.conf.set(key, str(rows))

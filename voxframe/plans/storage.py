"""Results that several branches of a plan read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share. Only a local master, as in tests, may do without one."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="voxframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """Computed once and checkpointed: plans stay short and lost executors cost nothing."""
    shared_base(df.sparkSession)
    return df.checkpoint()

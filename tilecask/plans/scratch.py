"""Intermediate tables in the folder that driver and executors share, and small tables over all cores."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATH = "_scratch_path"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="tilecask-"))
    return sc.getCheckpointDir()


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet and read again: computed once, whatever reads it how often; its lineage ends here.

    The table outlives any executor. It goes with ``forget``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    setattr(out, _PATH, path)
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` made, once nothing lazy reads them any more. Other DataFrames are left alone."""
    for df in tables:
        path = getattr(df, _PATH, None)
        if path:
            where, files = _files(df.sparkSession, path)
            files.delete(where, True)
            files.cancelDeleteOnExit(where)


#: Where a table has fewer bytes for each core, its rows are dealt out.
FEW_BYTES = 4 << 20


def evenly(df: DataFrame) -> DataFrame:
    """``df``, its rows dealt over all cores where the whole table is small: a small file is one row group, hence one task.

    Larger tables stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * FEW_BYTES else df

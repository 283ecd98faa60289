"""Tables in the folder that driver and executors share, and checks of what is sent to every task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a table that may be dealt over all cores, which shuffles all of it.
SPREAD_BYTES = 1 << 30


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session names none, a local session gets a temporary folder; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        found = context._jsc.sc().getCheckpointDir()
    return found.get()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written once to the shared folder and read back; lineage ends here."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # for release()
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in whatever store Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is of at most ``SPREAD_BYTES`` and its scan has fewer parts than these (a few small files); a larger table is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files
    return df.repartition(cores) if size <= SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def if_small(df: DataFrame, rows: int) -> Callable[[DataFrame], DataFrame]:
    """Hint for this table: broadcast if it has at most so many rows (counted), else a sorted shuffle."""
    small = df.limit(rows + 1).count() <= rows
    return (lambda d: F.broadcast(d)) if small else (lambda d: d.hint("merge"))

"""Tables in the folder that driver and executors share, and tables of few partitions spread over all cores."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own on a single machine; on a cluster it must be set, since
    executors would write to their own disks."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="textmill-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table there: its lineage ends, and non-deterministic columns are fixed."""
    path = f"{shared_root(df.sparkSession)}/textmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_shared(spark: SparkSession) -> None:
    """Deletes the tables that this library wrote there. Only when no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/textmill")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(table: DataFrame) -> DataFrame:
    """A table as read, dealt anew if its files make fewer tasks than the cluster has cores; else as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table

"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, the warehouse's, which executors share too; a temporary one only on
    a local master, where driver and executors are one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="palimpsest-") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/_palimpsest"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return sc.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A place for a table in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and still there when executors are lost."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

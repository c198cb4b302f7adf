"""Where streams and packages put what several machines read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``, which goes when the application ends.

    Where that is unset, a temporary folder serves if all runs on one machine; on a cluster
    it is an error, since executors do not see each other's disks.
    """
    base = spark.conf.get(KEY, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{KEY} must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkveil-")
        spark.conf.set(KEY, base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read back: it is worked out once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""What operators need of the session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder that the cluster names, a temporary one only in a local session that names none."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "survperf-checkpoints"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in that folder, which goes when the session ends.

    A checkpoint keeps its plan's guess of its size, and a join's is the product of its sides': in a loop of joins the numbers would double
    their digits with each round. A table read again has the size of its files.
    """
    spark = df.sparkSession
    spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty() and cut(spark.range(1))
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)

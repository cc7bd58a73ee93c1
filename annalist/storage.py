"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or, where it is unset and Spark is local, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="annalist-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
        atexit.register(shutil.rmtree, at.removeprefix("file://"), True)
    return at


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and it survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/annalist-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the bytes that ``df`` reads; for files it is their size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)  # more stands for an unknown size

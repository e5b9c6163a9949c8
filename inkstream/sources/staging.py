"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this process and not yet released.
_STAGED: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in a local session that sets none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif spark.sparkContext.master.startswith(("local[", "local-cluster")) or spark.sparkContext.master == "local":
            folder = "file://" + tempfile.mkdtemp(prefix="inkstream-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: later stages don't depend on lost executors."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/inkstream-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that :func:`written` has written so far, once the results that read them are saved; their number."""
    hadoop, n = spark._jvm.org.apache.hadoop.fs.Path, len(_STAGED)
    for path in _STAGED:
        at = hadoop(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _STAGED.clear()
    return n

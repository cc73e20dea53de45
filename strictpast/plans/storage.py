"""Where intermediate tables go: the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The configured folder; a temporary one only in local mode where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="strictpast-")
    spark.sparkContext.setCheckpointDir(found)
    return found


#: The tables of the scratches that are open.
_OPEN: list[list] = []


@contextmanager
def scratch():
    """Tables materialised inside go on leaving; what is computed from them must be read or written before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for files, target in _OPEN.pop():
            files.delete(target, True)


def materialised(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the files go with the driver's JVM or the ``scratch`` around."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/strictpast/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.deleteOnExit(target)
    if _OPEN:
        _OPEN[-1].append((files, target))
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

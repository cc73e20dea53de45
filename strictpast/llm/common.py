"""Table access, shared-folder storage and small helpers for the training-data operators."""

from __future__ import annotations

import ctypes
import pickle
import sys
import tempfile
import types
import uuid
import warnings
import zlib
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="strictpast-")
    context.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


#: The tables of the scratches that are open.
_OPEN: list[list] = []


@contextmanager
def scratch():
    """Intermediate tables written inside go on leaving, so a long session doesn't fill the shared folder.

    What is computed from them must be read or written before.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for fs, target in _OPEN.pop():
            fs.delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when the driver's JVM ends, or with the ``scratch`` that this is called in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/strictpast/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    if _OPEN:
        _OPEN[-1].append((fs, target))
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def wrapped(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` as one struct ``row`` beside ``keys``, so no column name, with a dot or not, can clash with theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def unwrapped(df: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``wrapped`` under their names again."""
    return df.select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(names)])


def crc32_of_id(column: Column | str) -> Column:
    """Unsigned CRC-32 of an id's decimal text; a null id counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8"))


def crc32_of(value) -> int:
    """The same digest in Python."""
    return zlib.crc32(b"" if value is None else str(value).encode())


class Held:
    """A broadcast of any picklable object of bounded size, opened once in each worker."""

    def __init__(self, spark: SparkSession, value):
        self._sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._open = None

    def __getstate__(self):
        return {"_sent": self._sent, "_open": None}

    @property
    def value(self):
        if self._open is None:
            self._open = pickle.loads(self._sent.value)
        return self._open


def give_back(keep: tuple[str, ...] = ()) -> None:
    """Return freed memory to the system: workers live on from stage to stage, and all of an executor's share its limit.

    Of what ``once_a_process`` has kept, only the names in ``keep`` stay.
    """
    kept = vars(sys.modules.get(_KEPT, types.ModuleType(_KEPT)))
    for name in [x for x in kept if x not in keep and not x.startswith("__")]:
        del kept[name]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def frugal(run, *keep: str):
    """``run`` for mapInArrow; what it and the task before have freed or kept, but for ``keep``, goes back to the system."""

    def trimmed(batches):
        give_back(keep)
        yield from run(batches)
        give_back(keep)

    return trimmed


def bounded_sample(rows: DataFrame, group: str, limit: int, key: str = "id", most_groups: int = 256) -> DataFrame:
    """The ``limit`` rows of each group whose keys hash lowest (all, if fewer), as rows with their number ``rn``.

    At most the ``most_groups`` largest groups are sampled, so the sample is bounded whatever the group column holds; a
    warning tells of more. Groups are counted first, so that only about twice the rows that stay go through the ranking,
    whatever a group's size. The cut is by hash alone: with distinct keys a group falls short of its limit only if the
    hash fails it.
    """
    found = rows.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(most_groups + 1).collect()
    counts = {r[0]: r[1] for r in found[:most_groups]}
    if len(found) > most_groups:
        warnings.warn(f"only the {most_groups} largest groups of {group} are learned from", stacklevel=2)
        rows = rows.where(F.col(group).isin(list(counts)))
    chance = F.pmod(F.xxhash64(key), F.lit(1 << 40)) / float(1 << 40)
    share = F.lit(1.0)
    for name, n in counts.items():
        if n > 4 * limit:
            share = F.when(F.col(group) == name, F.lit(2.0 * limit / n)).otherwise(share)
    order = Window.partitionBy(group).orderBy(chance, key)
    return rows.where(chance < share).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)


_KEPT = "_strictpast_kept"


def once_a_process(name: str, make):
    """What ``make`` returns, kept in a worker process from task to task."""
    kept = vars(sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)))
    if name not in kept:
        kept[name] = make()
    return kept[name]

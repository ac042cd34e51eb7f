"""Shared working storage: tables that every executor can read, written once.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only in local
mode, where that is unset (unit tests), a temporary folder is made; on a cluster an
unset folder is an error, since no other machine could read it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
#: The folders of working tables of the innermost scope.
_OWN: ContextVar[list[str] | None] = ContextVar("own", default=None)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the shared folder, as a URI."""
    base = spark.sparkContext.getConf().get(_SETTING) or spark.conf.get(_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(_SETTING, base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor without
    running the earlier steps again.
    """
    path = shared_dir(df.sparkSession, purpose)
    own = _OWN.get()
    if own is not None:
        own.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Working tables that are written inside are removed on leaving, without those that are given to what this gives.

    These belong to the scope around, if any.  What is left of shuffles whose results are written goes too:
    Spark drops their files when the driver's JVM has collected what refers to them.
    """
    around, own, kept = _OWN.get(), [], []
    token = _OWN.set(own)

    def keep(table: DataFrame) -> DataFrame:
        files = table.inputFiles()
        kept.extend(path for path in own if any(f.rpartition("/")[0].endswith(path.rpartition("/")[2]) for f in files))
        return table

    try:
        yield keep
    finally:
        _OWN.reset(token)
        if around is not None:
            around.extend(kept)
        for path in own:
            if path not in kept:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it is read from fewer files than there are cores.

    A file of one row group is one task, whatever is computed from it.  A table of many files is
    left as it lies, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def write_bytes(path: str, data: bytes) -> None:
    """Write a file from a task: whole under another name first, then renamed."""
    store, name = pafs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    own = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as f:
        f.write(data)
    store.move(own, name)


def read_bytes(path: str) -> bytes:
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as f:
        return f.read()

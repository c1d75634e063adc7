"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Without one there is no folder that every machine sees."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        # All of Spark is this process, as in tests.
        root = "file://" + os.path.join(tempfile.gettempdir(), "scrivano-scratch")
    return root


#: The tables of the open ``temporary`` blocks of this thread.
_OPEN: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("open", default=())


@contextlib.contextmanager
def temporary():
    """Remove at the end the tables that are written inside, but for those taken out of the list."""
    tables: list[DataFrame] = []
    before = _OPEN.set((*_OPEN.get(), tables))
    try:
        yield tables
    finally:
        _OPEN.reset(before)
        discard(*tables)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, every
    executor sees it, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/scrivano-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _OPEN.get():
        _OPEN.get()[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove written tables whose readers have all been written in their turn."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)

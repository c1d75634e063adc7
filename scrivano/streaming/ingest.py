"""Incremental ingestion of documents with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_incoming(spark: SparkSession, path: str, schema: str, per_batch: int = 50) -> DataFrame:
    """New Parquet files of a folder, at most ``per_batch`` a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).parquet(path)


def ingest(source: DataFrame, target: str, checkpoint: str, key: str, transform: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None) -> StreamingQuery:
    """Append rows whose key the target lacks.

    The checkpoint tells which files are done; a batch that runs again finds its
    keys in the target, so a replay writes nothing twice.  Without ``every`` all
    that is there is taken once.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = (transform(batch) if transform else batch).dropDuplicates([key])
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(target)
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        if there:
            rows = rows.join(spark.read.parquet(target).select(key), key, "left_anti")
        rows.write.mode("append").parquet(target)

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def commit_batch(batch: DataFrame, target: str, run: str, number: int) -> bool:
    """Write one batch under its run and number; false if it has been committed before.

    The rows go to a folder of their own, and a manifest is created last, in one step.  A
    batch without a manifest was cut off: what is there of it goes, and it is written anew.
    Nothing else of the target is read.
    """
    spark = batch.sparkSession
    done, rows = f"{target}/manifests/{run}-{number}", f"{target}/rows/run={run}/batch={number}"
    if _exists(spark, done):
        return False
    _remove(spark, rows)
    batch.write.parquet(rows)
    place = spark._jvm.org.apache.hadoop.fs.Path(done)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    out.write(bytearray(f"{run}-{number}", "utf-8"))
    out.close()
    return True


def ingest_committed(source: DataFrame, target: str, checkpoint: str, key: str, run: str, transform: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None) -> StreamingQuery:
    """Append batches by ``commit_batch``.  Keys that come again in the run are dropped by the stream's state.

    run names this stream; its checkpoint and its batches belong together.
    """

    def write(batch: DataFrame, number: int) -> None:
        commit_batch(transform(batch) if transform else batch, target, run, number)

    writer = source.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_committed(spark: SparkSession, target: str, schema: str, key: str | None = None) -> DataFrame:
    """The rows of all committed batches; with a key, of several runs' rows of one key that of the first run by name."""
    full = f"{schema}, run string, batch long"
    if not _exists(spark, f"{target}/manifests"):
        return spark.createDataFrame([], full)
    done = spark.read.text(f"{target}/manifests", wholetext=True).select(F.regexp_extract("value", r"(?s)^(.*)-\d+$", 1).alias("run"), F.regexp_extract("value", r"-(\d+)$", 1).cast("long").alias("batch"))
    rows = spark.read.schema(full).option("basePath", f"{target}/rows").parquet(f"{target}/rows").join(done, ["run", "batch"], "left_semi")
    names = [c for c in rows.columns if c not in ("run", "batch")]
    if key is None:
        return rows.select(*names, "run", "batch")
    first = F.min(F.struct("run", "batch", *(c for c in names if c != key))).alias("r")
    return rows.groupBy(key).agg(first).select(*(F.col(c) if c == key else F.col(f"r.{c}").alias(c) for c in names), "r.run", "r.batch")

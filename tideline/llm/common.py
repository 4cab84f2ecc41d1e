"""Reading, writing and column names that the operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Where it names none (tests), a
    folder under the warehouse directory is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and any executor can read it again. The
    step's shuffle files go with it, so the disk holds what one step needs. Python gets at most so many
    rows at once, where they are given: both sides hold such a batch in memory."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    conf = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | ({"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)} if rows else {})
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the broadcasts and shuffles of plans that nobody holds any more: its cleaner acts
    only when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_written(df: DataFrame) -> None:
    """Remove a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: str, n: int):
    """crc32 of an id's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def batch_of(names: list[str], arrays: list, schema: pa.Schema | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=names)


_settled: list[bool] = []


def give_back() -> None:
    """Free what cycles hold, and return free pages. What is there the first time, mostly modules, is not
    looked at again: later calls cost next to nothing."""
    gc.collect()
    if not _settled:
        gc.freeze()
        _settled.append(True)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(run):
    """run, a function of Arrow batches, that gives the pages it freed back to the system when it ends: the
    workers that Spark keeps for the next tasks would hold them else."""

    def f(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return f


def through(df: DataFrame, change) -> DataFrame:
    """df with each Arrow batch changed: change(batch) gives a batch of the same columns."""

    def run(batches):
        for batch in batches:
            yield change(batch)

    return df.mapInArrow(trimmed(run), df.schema)

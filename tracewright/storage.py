"""Intermediate results in the folder that all machines share: written once, read again, deleted when used up."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most bytes that go to a Python worker at once (Spark's own bound is by rows, and texts may be long).
BATCH_BYTES, BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Whether a query's shuffle files are removed when it ends: set while intermediate results are written.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What opening a file counts as in bytes when files are packed into tasks, and the value for many small ones: then
#: a task reads up to 2048 of them, not 32.
OPEN_COST, SMALL_FILE = "spark.sql.files.openCostInBytes", 1 << 16


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_LIMIT bytes; a smaller limit of its own stays."""
    held = spark.conf.get(BATCH_BYTES).removesuffix("b")
    if not (held.isdecimal() and 0 < int(held) <= BATCH_LIMIT):
        spark.conf.set(BATCH_BYTES, str(BATCH_LIMIT))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see, from spark.checkpoint.dir.

    Where a local session names none (tests) a folder of this process is made and set as the checkpoint
    folder; on a cluster such a folder would be seen by one machine only, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if not held:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tracewright-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def durable(df: DataFrame, what: str, small_files: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, a lost executor costs nothing.

    The shuffle files of the write go with it (nothing reads them again), not when the driver happens to
    collect its garbage. With small_files, df reads very many small files, and tasks get many of them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    settings = {SHUFFLE_CLEANUP: "true"} | ({OPEN_COST: str(SMALL_FILE)} if small_files else {})
    before = {k: spark.conf.get(k) for k in settings}
    bound_batches(spark)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a durable() frame that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)

"""Durable intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is chosen only for a session without it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch on its way to a Python worker, and the setting for them, which counts rows only up to far more.
BATCH, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let batches for Python workers be small in this session, unless its user has chosen their size: rows here are whole texts, and each batch is held on both sides."""
    if spark.conf.get(BATCH_SETTING).rstrip("bB") == str(64 << 20):
        spark.conf.set(BATCH_SETTING, str(BATCH))


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts lineage: an executor that is lost later costs a re-read, not a
    recomputation, and a plan with random or range partitioning is fixed.
    """
    path = path or scratch(df.sparkSession, name)
    bounded_batches(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


#: Rows of a task where each costs about a millisecond of Python, and the fewest worth a task.
ROWS_A_TASK, FEWEST = 4096, 64


def spread(df: DataFrame, key: str, count: int | None = None) -> DataFrame:
    """``df``, of which ``count`` rows are known or counted, dealt by ``key`` over tasks for work that costs much a row: small files and row groups give few tasks by themselves."""
    count = df.count() if count is None else count
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores, -(-count // FEWEST)), -(-count // ROWS_A_TASK)), key)


def discarded(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that no later plan reads: what was made of them must itself be written or collected."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

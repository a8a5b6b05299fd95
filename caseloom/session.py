"""Session settings shared by all operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset
    and no folder was set before (local runs and tests) a scratch folder of
    this machine is taken.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(shared)
    return shared


_RUNS: list[str] = []


@contextlib.contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for the tables that are ``written`` inside the ``with``, deleted at its end.

    Write or fetch results inside: they are read from these tables.
    """
    path = f"{checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"
    _RUNS.append(path)
    try:
        yield path
    finally:
        _RUNS.remove(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and drop its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a checkpoint the copy is columnar and compressed, later reads prune
    columns, and its statistics give later joins a proven size.
    """
    spark = df.sparkSession
    path = f"{_RUNS[-1] if _RUNS else checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores.

    A table in fewer files than cores would leave cores idle in costly stages
    over its texts. Tables in many files stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

"""Written intermediate tables, so that lost executors cost a re-read only."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from likeness.sources.readers import delete

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder serves only where Spark itself runs on one machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="likeness-"))
        return context.getCheckpointDir()
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the actions within are deleted as each of them ends.

    Spark otherwise keeps them until the driver happens to collect its garbage.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def written(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """Write a table under the checkpoint folder and read it back.

    Unlike a checkpoint of rows the table is columnar: later steps that need
    its keys only do not read its vectors.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_written(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """The rows of several written tables of one schema."""
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A folder for tables that only the steps within read; it is deleted after them."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete(spark, path)

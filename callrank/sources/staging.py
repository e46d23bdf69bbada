"""Written intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

#: The folder of the scratch block at hand.
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names; a local one only in local mode where none is named (tests)."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="callrank-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for the intermediate tables of one run, within the scratch folder if there is one."""
    above = _scratch.get() or f"{checkpoint_dir(spark).rstrip('/')}/callrank"
    return f"{above}/{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder that holds whatever is staged meanwhile and is deleted at the end: what is to stay is written elsewhere."""
    folder = new_folder(spark)
    token = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(token)
        discard(spark, folder)


def stage(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of what was written.

    The result has no lineage: a lost executor costs a re-read, not a recomputation, and values
    that depend on how rows were laid out (see ``rank.add_rank``) are fixed for good. Unlike an RDD
    checkpoint, parquet keeps column pruning, filter push-down and size estimates.
    """
    spark = df.sparkSession
    path = f"{folder or new_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str) -> None:
    """Delete the intermediate tables of a finished run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

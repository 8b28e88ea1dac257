"""Tables in the folder that driver and executors share, for cutting lineage so that lost executors cost no rework."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a folder of our own, in local mode only.

    On a cluster a folder of the driver's machine would lose the executors' rows, so there the setting is needed.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='hitwatch-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths handed out inside each open ``temporary`` block.
_OPEN: list[list[str]] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = f"{shared_dir(spark)}/hitwatch/{label}-{uuid.uuid4().hex}"
    for paths in _OPEN:
        paths.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Clears what was stored inside the block when it ends; results have to be written before, as they are read from there."""
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield
    finally:
        _OPEN[:] = [p for p in _OPEN if p is not paths]
        for path in paths:
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path on whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path is a folder, on whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


class Stored:
    """A DataFrame written to the shared folder; ``df`` reads it again."""

    def __init__(self, df: DataFrame, label: str) -> None:
        self.spark = df.sparkSession
        self.path = scratch(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def discard(self) -> None:
        discard(self.spark, self.path)

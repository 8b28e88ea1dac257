"""Helpers that several operators share: shared scratch space, hash folds, bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitwatch.sources.scratch import Stored, discard, scratch, shared_dir

__all__ = ["BROADCAST_ROWS", "Stored", "bounded", "crc_fold", "discard", "read", "scratch", "shared_dir"]

#: Sides of a join up to this many rows, of 150 bytes or less each, are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id as decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def bounded(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows of ``df`` at most, chosen by a hash of ``key``: the same rows at every partitioning."""
    n = df.count()
    if n <= rows:
        return df
    share = int(rows / n * 1_000_000_000)
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000_000)) < share)

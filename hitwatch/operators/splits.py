"""File lists, splits and resampling; every order is that of a hash of key and seed, so it never depends on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitwatch.operators.index import with_global_index


def shuffle_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def shuffled(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """``df`` with each row's place in a seeded shuffle by ``key``."""
    return with_global_index(df.withColumn("_k", shuffle_key(key, seed)), [F.col("_k"), F.col(key)], name).drop("_k")


def data_files(files: DataFrame, column: str = "path", prefix: str = "DQM", suffix: str = ".root") -> DataFrame:
    """Rows whose file name (after the last slash) starts and ends so."""
    name = F.substring_index(column, "/", -1)
    return files.filter(name.startswith(prefix) & name.endswith(suffix))


def rewrite_url(path: Column, old: str, new: str) -> Column:
    """The path with ``new`` in place of the prefix ``old``."""
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 20))).otherwise(path)


def train_test_files(files: DataFrame, runs: DataFrame, *, path: str = "path", run: str = "run", share: float = 0.8, seed: int = 0) -> DataFrame:
    """(path, split, label): the first ``int(share * n)`` good files in shuffled order train, the rest and all bad ones test.

    Repeated files and runs count once, so nothing leaks across the split; runs that are neither are left out.
    """
    marked = files.select(path, run).distinct().join(runs.select(run, "good").distinct(), run).select(path, "good").distinct()
    good = marked.filter("good").select(path)
    n = good.count()
    placed = shuffled(good, path, seed)
    train = placed.select(path, F.when(F.col("place") < int(n * share), "train").otherwise("test").alias("split"), F.lit(0).alias("label"))
    return train.unionByName(marked.filter("NOT good").select(path, F.lit("test").alias("split"), F.lit(1).alias("label")))


def validation_size(n: int, share: float) -> int:
    """Rows of the validation part; 0 unless the share is inside (0, 1), there are two rows and both parts get some."""
    if not 0 < share < 1 or n < 2:
        return 0
    k = round(n * share)
    return 0 if k in (0, n) else k


def validation_split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """``df`` with ``is_validation``: the last rows in shuffled order."""
    n = df.count()
    k = validation_size(n, share)
    return shuffled(df, key, seed).withColumn("is_validation", F.col("place") >= n - k).drop("place")


def bootstrap(df: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows drawn with replacement: (draw, columns of df); an equi-join of hashed places with the rows' index."""
    n = df.count()
    if not n:
        return df.select(F.lit(0).cast("long").alias("draw"), "*").limit(0)
    placed = with_global_index(df, [F.col(key)], "_place")
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    draws = df.sparkSession.range(size).select(F.col("id").alias("draw"), F.pmod(number, F.lit(n)).alias("_place"))
    return draws.join(placed, "_place").drop("_place")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in an order, as a cap on events, windows or scores."""
    return df.orderBy(*order).limit(n)

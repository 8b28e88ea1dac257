"""Column functions that build and clean per-event feature vectors (``array<double>``); all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZERO = 0.0


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def bound(value: Column, then) -> Column:
    """``then(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def empty() -> Column:
    return F.array().cast("array<double>")


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(ZERO), n)


def flatten_waveform(v: Column) -> Column:
    """One array of a channel-by-tick array; null counts as empty."""
    return F.coalesce(F.flatten(v).cast("array<double>"), empty())


def pad(v: Column, length: int | Column) -> Column:
    """Exactly ``length`` values: cut, or filled up with zeros; null counts as empty."""
    n = F.lit(length) if isinstance(length, int) else length
    return bound(F.coalesce(doubles(v), empty()), lambda x: F.slice(F.concat(x, zeros(F.greatest(n - F.size(x), F.lit(0)))), F.lit(1), n))


def window(v: Column, first: int, length: int) -> Column:
    """Values from place ``first`` on, exactly ``length`` of them, zeros beyond the end."""
    return pad(F.slice(F.coalesce(doubles(v), empty()), first + 1, length), length)


def interleave(branches: Sequence[Column], hits: int | None = None) -> Column:
    """b0[0], b1[0], ..., b0[1], b1[1], ...: branches padded with zeros to the longest, or all to ``hits`` hits.

    Null branches (absent ones) are skipped, so they take no places.
    """
    if hits is not None and hits <= 0:
        raise ValueError("hits must be positive")

    def join(there: Column) -> Column:
        n = F.lit(hits) if hits is not None else F.coalesce(F.array_max(F.transform(there, F.size)), F.lit(0))
        body = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(there, lambda b: F.coalesce(F.get(b, i), F.lit(ZERO)))))
        return F.when((n > 0) & (F.size(there) > 0), body).otherwise(empty())

    return bound(F.filter(F.array(*map(doubles, branches)), lambda b: b.isNotNull()), join)


def zip_hits(**columns: Column) -> Column:
    """Array of structs of parallel arrays, as long as the shortest, without negative channels."""
    n = F.least(*map(F.size, columns.values())) if len(columns) > 1 else F.size(next(iter(columns.values())))
    cut = F.arrays_zip(*[F.slice(c, F.lit(1), n).alias(k) for k, c in columns.items()])
    return F.filter(cut, lambda h: h["channel"] >= 0)


def first_value(v: Column) -> Column:
    """First value of an array column, null when it is null or empty."""
    return F.get(v, F.lit(0))


def _moments(x: Column) -> Column:
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / n
    return bound(mean, lambda m: F.struct(m.alias("mean"), F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, b: a + (b - m) * (b - m)) / n).alias("std")))


def zscore_keep(v: Column) -> Column:
    """z-score by population deviation; vectors without spread (or with NaN) stay as they are."""
    return bound(doubles(v), lambda x: bound(_moments(x), lambda m: F.when((m["std"] > 0) & ~F.isnan(m["std"]), F.transform(x, lambda e: (e - m["mean"]) / m["std"])).otherwise(x)))


def zscore_unit(v: Column) -> Column:
    """z-score by population deviation, or by 1 where there is no spread."""
    return bound(doubles(v), lambda x: bound(_moments(x), lambda m: F.transform(x, lambda e: (e - m["mean"]) / F.when((m["std"] > 0) & ~F.isnan(m["std"]), m["std"]).otherwise(1.0))))


def _finite(e: Column) -> Column:
    return ~(F.isnan(e) | (F.abs(e) == float("inf")))


def repair(v: Column) -> Column:
    """NaN and infinities become 0."""
    return F.transform(doubles(v), lambda e: F.when(_finite(e), e).otherwise(ZERO))


def has_non_finite(v: Column) -> Column:
    return F.exists(doubles(v), lambda e: ~_finite(e))


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays of equal length."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, e: s + e) / F.size(a)


def pad_to_longest(df: DataFrame, column: str) -> DataFrame:
    """``column`` filled up with zeros to the longest vector of the table."""
    longest = df.agg(F.coalesce(F.max(F.size(column)), F.lit(0)).alias("_longest"))
    return df.crossJoin(F.broadcast(longest)).withColumn(column, pad(F.col(column), F.col("_longest"))).drop("_longest")


def zscore_columns(df: DataFrame, column: str, eps: float = 1e-6) -> DataFrame:
    """Each place of the vectors z-scored over all rows: (x - mean) / (population deviation + eps)."""
    stats = df.select(F.posexplode(doubles(F.col(column))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    # one row: as many numbers as a vector has places
    table = stats.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m", "s"))), lambda t: F.struct(t["m"].alias("m"), t["s"].alias("s"))).alias("_stats"))
    scored = F.zip_with(doubles(F.col(column)), F.col("_stats"), lambda x, t: (x - t["m"]) / (t["s"] + F.lit(eps)))
    return df.crossJoin(F.broadcast(table)).withColumn(column, F.slice(scored, F.lit(1), F.size(column))).drop("_stats")


def zscore_all(df: DataFrame, column: str, eps: float = 1e-6) -> DataFrame:
    """All values of all vectors z-scored by one mean and deviation."""
    stats = df.select(F.explode(doubles(F.col(column))).alias("x")).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return df.crossJoin(F.broadcast(stats)).withColumn(column, F.transform(doubles(F.col(column)), lambda x: (x - F.col("_m")) / (F.col("_s") + F.lit(eps)))).drop("_m", "_s")


def feature_label(index: Column, variables: Sequence[str]) -> Column:
    """Struct (variable, hit) of a place in a whole-hit vector."""
    n = len(variables)
    return F.struct(F.element_at(F.array(*map(F.lit, variables)), (index % n).cast("int") + 1).alias("variable"), F.floor(index / n).cast("long").alias("hit"))

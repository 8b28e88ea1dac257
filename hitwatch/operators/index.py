"""Global order: dense row indexes and prefix sums without a single-task window.

Rows are range-partitioned and sorted, and the result is stored, so both passes see the same partitions. The
per-partition totals are as many rows as there are partitions; their running sums are joined back.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitwatch.functions.names import fresh
from hitwatch.sources.scratch import Stored

#: Key columns of events, in order.
KEYS = ("run", "subrun", "evt")
_PLACE_BITS = 33  # monotonically_increasing_id keeps the place in the partition in its lower bits


def _ranged(df: DataFrame, order: list[Column]) -> tuple[DataFrame, str, str]:
    """The rows in order, stored, with their partition and their place in it, in columns whose names are given too."""
    at, part, pos = fresh(df.columns, "_at", "_part", "_pos")
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    stored = Stored(placed, "ordered").df
    return stored.withColumn(part, F.shiftright(at, _PLACE_BITS)).withColumn(pos, F.col(at).bitwiseAND((1 << _PLACE_BITS) - 1)).drop(at), part, pos


def _before(totals: DataFrame, part: str, names: dict[str, str]) -> DataFrame:
    """Exclusive running sums over partitions, under new names; a row a partition."""
    w = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(part, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(new) for n, new in names.items()])


def indexed(df: DataFrame, order: list[Column], name: str = "idx") -> tuple[DataFrame, int]:
    """``df`` with the place 0, 1, ... of each row in the given order, which should be total, and the number of rows."""
    ranged, part, pos = _ranged(df, order)
    totals = ranged.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect()  # a row a partition
    before, n = [], 0
    for row in totals:
        before.append((row[part], n))
        n += row["n"]
    (first,) = fresh(ranged.columns, "_before")
    offsets = df.sparkSession.createDataFrame(before, f"`{part}` long, `{first}` long")
    return ranged.join(F.broadcast(offsets), part).withColumn(name, F.col(pos) + F.col(first)).drop(part, pos, first), n


def with_global_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """``df`` with the place 0, 1, ... of each row in the given order, which should be total."""
    return indexed(df, order, name)[0]


def prefix_sum(df: DataFrame, order: list[Column], values: dict[str, str], inclusive: bool = True) -> DataFrame:
    """``df`` with running sums in the given order; ``values`` maps value columns to names of sums."""
    ranged, part, pos = _ranged(df, order)
    made = fresh([*ranged.columns, *values.values()], *[f"_{kind}_{v}" for kind in ("before", "local") for v in values])
    first, local = dict(zip(values, made, strict=False)), dict(zip(values, made[len(values) :], strict=True))
    before = _before(ranged.groupBy(part).agg(*[F.sum(v).alias(v) for v in values]), part, first)
    w = W.partitionBy(part).orderBy(pos).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    summed = ranged.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(local[v]) for v in values]).join(F.broadcast(before), part)
    for v, name in values.items():
        summed = summed.withColumn(name, F.col(local[v]) + F.col(first[v]))
    return summed.drop(part, pos, *made)


def event_order(zero_is_missing: bool = False, columns: Collection[str] = KEYS) -> list[Column]:
    """Order of events: by those of (run, subrun, evt) that are among ``columns``, missing keys last, ties in file order; without any, file order alone."""
    from hitwatch.functions.keys import sort_key

    return [*[sort_key(F.col(c), zero_is_missing) for c in KEYS if c in columns], F.col("file_idx"), F.col("entry")]


def order_events(events: DataFrame, *, zero_is_missing: bool = False, name: str = "event_idx") -> DataFrame:
    """Events with their dense index in event order, by whichever key columns there are."""
    return with_global_index(events, event_order(zero_is_missing, events.columns), name)


def csr_offsets(indexed: DataFrame, hits: DataFrame, key: str = "evt") -> DataFrame:
    """(event_idx, n_hits, begin, end): where each event's hits lie in the global hit order; empty events included."""
    counts = hits.groupBy(key).agg(F.count("*").alias("n_hits"))
    counted = indexed.select("event_idx", key).join(counts, key, "left").select("event_idx", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"))
    return prefix_sum(counted, [F.col("event_idx")], {"n_hits": "end"}).select("event_idx", "n_hits", (F.col("end") - F.col("n_hits")).alias("begin"), "end")

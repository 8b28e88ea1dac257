"""Event store whose files a range of events names: a row an event with its hits as an array, in buckets of the event index.

Events and hits meet once, when the store is written: both are range-partitioned by event index together, and grouped where they lie. After that a range of
events or windows reads its buckets alone, hits need no join with the index, and what is worked out for one event needs no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitwatch.operators.windows import Layout

EVENT_COLUMNS = ("run", "subrun", "evt", "file_idx")


def save(events: DataFrame, hits: DataFrame, path: str, per_bucket: int = 65_536) -> None:
    """Write indexed events (event_idx and keys) and their hits (event_idx, channel, integral and whatever else) as a store.

    Events without hits have an empty array. A bucket holds ``per_bucket`` events; an event's hits are in one row, as in a detector's own files.
    """
    kept = [c for c in EVENT_COLUMNS if c in events.columns]
    hit = F.struct(*[c for c in hits.columns if c not in ("event_idx", *EVENT_COLUMNS)])
    mine = events.select("event_idx", F.struct(*kept).alias("event"), F.lit(None).alias("hit"))
    theirs = hits.select("event_idx", F.lit(None).alias("event"), hit.alias("hit"))
    # one exchange: rows of a range of events are together, so the grouping finds its keys where they are
    met = mine.unionByName(theirs).repartitionByRange("event_idx")
    grouped = met.groupBy("event_idx").agg(F.max("event").alias("event"), F.sort_array(F.collect_list("hit")).alias("hits")).filter("event IS NOT NULL")
    rows = grouped.select("event_idx", "event.*", "hits", F.floor(F.col("event_idx") / per_bucket).cast("long").alias("bucket"))
    rows.sortWithinPartitions("bucket", "event_idx").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/events")
    rows.sparkSession.createDataFrame([(per_bucket,)], "per_bucket long").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Events from ``first`` to ``last`` (all where they are not given): only their buckets' files are read, and their row groups there."""
    df = spark.read.parquet(f"{path}/events")
    per_bucket = spark.read.parquet(f"{path}/settings").first()["per_bucket"]
    if first is not None:
        df = df.filter((F.col("bucket") >= first // per_bucket) & (F.col("event_idx") >= first))
    if last is not None:
        df = df.filter((F.col("bucket") <= last // per_bucket) & (F.col("event_idx") <= last))
    return df.drop("bucket")


def load_windows(spark: SparkSession, path: str, layout: Layout, first: int, last: int) -> DataFrame:
    """Events of the windows from ``first`` to ``last``."""
    return load(spark, path, first * layout.stride, last * layout.stride + layout.span - 1)


def hits_of(events: DataFrame) -> DataFrame:
    """(event_idx, hit columns): a row for each hit of stored events."""
    return events.select("event_idx", F.inline("hits"))

"""Hit tables: exploding and cleaning event arrays, channels, per-event channel partials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitwatch.functions.vectors import zip_hits


def explode_hits(events: DataFrame, planes: list[dict[str, str]], keep: list[str]) -> DataFrame:
    """A row for each hit: the arrays of every plane zipped, cleaned and joined in plane order.

    ``planes`` maps field names to array columns, ``channel`` among them; a plane with absent columns is skipped.
    """
    there = [p for p in planes if all(c in events.columns for c in p.values())]
    if not there:
        raise ValueError("no plane has all its columns")

    def cleaned(number: int, plane: dict[str, str]):
        zipped = zip_hits(**{k: F.col(f"`{c}`") for k, c in plane.items()})
        return F.coalesce(F.transform(zipped, lambda h: F.struct(F.lit(number).alias("plane_ord"), *[h[k].alias(k) for k in plane])), F.array())

    hits = F.concat(*[cleaned(i, p) for i, p in enumerate(there)])
    return events.select(*keep, F.posexplode(hits).alias("pos", "_h")).select(*keep, F.col("pos").cast("long").alias("pos"), "_h.*")


def channel_count(hits: DataFrame) -> int:
    """One more than the largest channel; 0 without hits."""
    return int(hits.agg(F.coalesce(F.max("channel") + 1, F.lit(0)).alias("n")).first()["n"])


def index_hits(hits: DataFrame, indexed: DataFrame, key: str = "evt", broadcast_events: int = 1_000_000, n_events: int | None = None) -> DataFrame:
    """Hits with the dense index of their event; the events' keys, some 16 bytes each, are broadcast only if they are few (``n_events``, else counted)."""
    keys = indexed.select(key, "event_idx")
    n = keys.count() if n_events is None else n_events
    return hits.join(F.broadcast(keys) if n <= broadcast_events else keys, key)


def channel_partials(hits: DataFrame, n_channels: int | None = None) -> DataFrame:
    """Mergeable partials of each (event_idx, channel): sum, count, min, max and sum of squares.

    Hits that came to their index by a join on ``evt`` are grouped by it too: where the join has dealt them by it, they stay where they are.
    """
    sound = hits.filter("channel >= 0") if n_channels is None else hits.filter(F.col("channel").between(0, n_channels - 1))
    x = F.col("integral").cast("double")
    grouped = sound.groupBy(*[c for c in ("evt",) if c in hits.columns], "event_idx", "channel")
    return grouped.agg(F.sum(x).alias("sum"), F.count(x).alias("cnt"), F.min(x).alias("min"), F.max(x).alias("max"), F.sum(x * x).alias("sum_sq")).drop("evt")


def hit_partials(hits: DataFrame, n_channels: int | None = None) -> DataFrame:
    """The partials of ``channel_partials`` with a row for each hit, so without an exchange; they merge to the same features."""
    sound = hits.filter("channel >= 0" if n_channels is None else F.col("channel").between(0, n_channels - 1)).filter("integral IS NOT NULL")
    x = F.col("integral").cast("double")
    return sound.select("event_idx", "channel", x.alias("sum"), F.lit(1).cast("long").alias("cnt"), x.alias("min"), x.alias("max"), (x * x).alias("sum_sq"))


def concat_metadata(events: DataFrame, columns: list[str], out: str = "meta_values") -> DataFrame:
    """All values of the metadata columns of an event in one array, in order; missing columns and nulls skipped."""
    arrays = []
    for name in (c for c in columns if c in events.columns):
        kind = dict(events.dtypes)[name]
        col = F.col(f"`{name}`")
        arrays.append(F.coalesce(col.cast("array<double>"), F.array().cast("array<double>")) if kind.startswith("array") else F.when(col.isNull(), F.array().cast("array<double>")).otherwise(F.array(col.cast("double"))))
    return events.withColumn(out, F.concat(*arrays) if arrays else F.array().cast("array<double>"))

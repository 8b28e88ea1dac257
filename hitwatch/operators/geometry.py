"""Wire positions: XML snippets to rows, lookups by name or channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitwatch.functions.keys import wire_name

_SCHEMA = "_name STRING, _x DOUBLE, _y DOUBLE, _z DOUBLE"


def _positions(raw: DataFrame, prefix: str | None, keep: list[str]) -> DataFrame:
    named = raw.select(*keep, F.col("_name").alias("name"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_z").alias("z"))
    chosen = named if prefix is None else named.filter(F.col("name").startswith(prefix))
    return chosen.select("*", wire_name(F.col("name")).alias("_w")).select(*chosen.columns, "_w.plane", "_w.channel", "_w.wire")


def read_positions(spark: SparkSession, path: str, prefix: str | None = None) -> DataFrame:
    """``position`` elements at any depth of XML files; a missing or unreadable attribute fails the read."""
    raw = spark.read.format("xml").option("rowTag", "position").option("mode", "FAILFAST").schema("_name STRING NOT NULL, _x DOUBLE NOT NULL, _y DOUBLE NOT NULL, _z DOUBLE NOT NULL").load(path)
    checked = raw.select(*[F.when(F.col(c).isNull(), F.raise_error(F.lit(f"position without {c[1:]}"))).otherwise(F.col(c)).alias(c) for c in raw.columns])
    return _positions(checked, prefix, [])


def parse_positions(df: DataFrame, column: str, prefix: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each text column value that is one ``position`` element."""
    parsed = df.select(*keep, F.from_xml(F.col(column), _SCHEMA, {"mode": "FAILFAST"}).alias("_p")).select(*keep, "_p.*")
    return _positions(parsed, prefix, list(keep))


def position_lookup(positions: DataFrame, order: str) -> DataFrame:
    """One position a name: the last one in the order of a column."""
    w = W.partitionBy("name").orderBy(F.desc(order))
    return positions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def add_positions(rows: DataFrame, positions: DataFrame, on: str = "channel", broadcast_rows: int = 500_000) -> DataFrame:
    """``rows`` with x, y, z of their channel or wire; the table, some 50 bytes a row, is broadcast only if it is small."""
    place = positions.filter(F.col(on).isNotNull()).select(on, "x", "y", "z")
    return rows.join(F.broadcast(place) if place.count() <= broadcast_rows else place, on, "left")

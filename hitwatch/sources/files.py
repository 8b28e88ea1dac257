"""Inputs and outputs: path lists, manifests, event and hit tables, run lists, results."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hitwatch.functions.keys import ordered_union

_LISTS = (".txt", ".lst", ".csv")
_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://")


def read_manifest(spark: SparkSession, path: str) -> list[str]:
    """Paths in a list file, one a line; blank lines and comments are skipped. As long as the list of inputs."""
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.monotonically_increasing_id().alias("i"))
    return [r["v"] for r in lines.filter("v <> '' AND NOT startswith(v, '#')").orderBy("i").collect()]


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    return sorted(str(s.getPath().toString()) for s in found)


def resolve_inputs(spark: SparkSession, inputs: str | Sequence[str]) -> list[str]:
    """Paths of files, globs and list files. URLs stay as they are, and so does what matches nothing."""
    out: list[str] = []
    for item in [inputs] if isinstance(inputs, str) else inputs:
        if _SCHEME.match(item):
            out.append(item)
        elif item.endswith(_LISTS):
            out += resolve_inputs(spark, read_manifest(spark, item))
        else:
            out += _glob(spark, item) or [item]
    return out


def file_slice(paths: Sequence[str], start: int = 0, count: int | None = None) -> list[str]:
    """Part of a path list for one of several jobs."""
    if start < 0 or start >= len(paths):
        raise ValueError(f"start {start} is not in a list of {len(paths)} files")
    return list(paths[start : None if count is None else start + count])


def read_events(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None, *, schema: StructType | None = None, on_missing: str = "raise", skip_corrupt: bool = True) -> DataFrame:
    """Event columns of Parquet files, with ``source_file``; missing files raise or are skipped, corrupt ones are skipped."""
    if on_missing not in ("raise", "skip"):
        raise ValueError("on_missing must be raise or skip")
    reader = spark.read.option("ignoreCorruptFiles", skip_corrupt).option("ignoreMissingFiles", on_missing == "skip").option("mergeSchema", schema is None)
    there = [p for p in paths if _glob(spark, p)] if on_missing == "skip" else list(paths)
    if not there:
        if schema is None:
            raise FileNotFoundError("none of the input files is there")
        return spark.createDataFrame([], schema).withColumn("source_file", F.lit(None).cast("string"))
    df = (reader.schema(schema) if schema is not None else reader).parquet(*there)
    names = list(columns) if columns is not None else df.columns
    wanted = [F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in names]
    return df.select(*wanted, F.col("_metadata.file_path").alias("source_file"))


def input_columns(branches: Sequence[str], hit_branches: Sequence[str] = (), metadata: Sequence[str] = ()) -> list[str]:
    """Columns to read: all named ones once, in order."""
    return ordered_union(list(branches), list(hit_branches), list(metadata))


def flat_values(df: DataFrame, column: str) -> DataFrame:
    """(value): all values of an array column, nested or not, one a row."""
    nested = dict(df.dtypes)[column].startswith("array<array")
    return df.select(F.explode(F.flatten(column) if nested else F.col(column)).alias("value"))


def with_file_index(df: DataFrame, column: str = "source_file", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """``df`` with ``file_idx``, the place of the source file in the sorted list of files, which is broadcast only if its paths are few bytes."""
    from hitwatch.operators.index import with_global_index

    files = with_global_index(df.select(column).filter(F.col(column).isNotNull()).distinct(), [F.col(column)], "file_idx")
    size = files.agg(F.coalesce(F.sum(F.octet_length(column) + 24), F.lit(0))).first()[0]
    return df.join(F.broadcast(files) if size <= broadcast_bytes else files, column, "left")


def unread_files(df: DataFrame, paths: Sequence[str], column: str = "source_file", pattern: str = "*.parquet") -> DataFrame:
    """(source_file) of the files under ``paths`` that gave ``df`` no row: corrupt ones that were skipped, and empty ones."""
    spark = df.sparkSession
    there = [p for p in paths if _glob(spark, p)]
    if not there:
        return spark.createDataFrame([], "source_file string")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(there).select(F.col("path").alias("source_file"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return listed.select(plain("source_file").alias("source_file")).join(df.select(plain(F.col(column)).alias("source_file")).distinct(), "source_file", "left_anti")


_EVENT_COLUMNS = {"event_idx": "long", "run": "long", "subrun": "long", "evt": "long", "file_idx": "long"}
_HIT_COLUMNS = {"event_idx": "long", "pos": "long", "channel": "long", "integral": "double", "time": "double", "wire": "long", "plane": "long", "tpc": "long"}


def save_events(events: DataFrame, hits: DataFrame, path: str) -> None:
    """Compact event store: tables ``events`` and ``hits`` under one folder."""
    events.write.mode("overwrite").parquet(f"{path}/events")
    hits.write.mode("overwrite").parquet(f"{path}/hits")


def load_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables of a compact event store; optional columns that were not saved are null."""

    def load(name: str, kinds: dict[str, str]) -> DataFrame:
        df = spark.read.parquet(f"{path}/{name}")
        return df.select(*df.columns, *[F.lit(None).cast(k).alias(c) for c, k in kinds.items() if c not in df.columns])

    return load("events", _EVENT_COLUMNS), load("hits", _HIT_COLUMNS)


def save_windows(features: DataFrame, meta: DataFrame, settings: dict, path: str, partition_by: str | None = None) -> None:
    """Window features, window metadata and the settings they were made with."""
    writer = features.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/windows")
    meta.write.mode("overwrite").parquet(f"{path}/meta")
    features.sparkSession.createDataFrame([(k, str(v)) for k, v in settings.items()], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")


def load_windows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    settings = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/settings").collect()}
    return spark.read.parquet(f"{path}/windows"), spark.read.parquet(f"{path}/meta"), settings


def flatten_bins(features: DataFrame, bins_column: str = "bins") -> DataFrame:
    """Bin-major, feature-minor flat vector of an array of per-bin feature arrays."""
    return features.withColumn(bins_column, F.flatten(bins_column))


def save_scores(window_scores: DataFrame, node_scores: DataFrame, path: str, settings: dict | None = None, filenames: DataFrame | None = None) -> None:
    """A scoring job's record: window scores with flags and provenance, node scores (inactive nodes have no row), and what they were made with.

    ``settings`` (threshold, number of channels, names of features ...) and ``filenames`` (file_idx, path) may be left out.
    """
    window_scores.write.mode("overwrite").parquet(f"{path}/window_scores")
    node_scores.write.mode("overwrite").parquet(f"{path}/node_scores")
    spark = window_scores.sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in (settings or {}).items()], "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")
    names = spark.createDataFrame([], "file_idx long, path string") if filenames is None else filenames.select(F.col("file_idx").cast("long"), "path")
    names.write.mode("overwrite").parquet(f"{path}/filenames")


def load_scores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(window scores, node scores)."""
    return spark.read.parquet(f"{path}/window_scores"), spark.read.parquet(f"{path}/node_scores")


def load_score_record(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """(settings, (file_idx, path)) of saved scores."""
    return {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/settings").collect()}, spark.read.parquet(f"{path}/filenames")


def write_csv(df: DataFrame, path: str) -> None:
    """Small result tables as CSV with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, good) from a JSON file of run lists ``good`` and ``bad``; repeated runs count once."""
    lists = spark.read.option("multiLine", True).json(path)
    parts = [lists.select(F.explode(F.col(c).cast("array<long>")).alias("run"), F.lit(c == "good").alias("good")) for c in ("good", "bad") if c in lists.columns]
    if not parts:
        raise ValueError("a run list needs good or bad runs")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()

"""Batches of a fixed number of events over file borders: numbered in a table, or admitted one a micro-batch by a stream.

An event's place in the whole input is its file's first place plus its row in the file. The files' sizes are counted once, by
Spark; after that a batch number is arithmetic, and nothing is sorted or exchanged.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from hitwatch.sources.scratch import discard

#: Paths and places of files up to so many bytes are broadcast; beyond it they are joined by an exchange.
BROADCAST_BYTES = 32 << 20
#: Rows that one task of a stream reads at most.
SLICE = 1 << 17


def _plain(path) -> F.Column:
    """One spelling of a local file's address."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def file_sizes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(ord, path, rows): the Parquet files of each path, in the order of ``paths`` and then of their names; files without rows are left out."""
    out: DataFrame | None = None
    for i, path in enumerate(paths):
        rows = spark.read.parquet(path).select(_plain(F.col("_metadata.file_path")).alias("path")).groupBy("path").agg(F.count("*").alias("rows"))
        found = rows.select(F.lit(i).alias("ord"), "path", "rows")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no path")
    return out


def with_batches(spark: SparkSession, paths: Sequence[str], size: int = 512, columns: Sequence[str] | None = None) -> DataFrame:
    """Events of Parquet files with the ``batch`` of ``size`` events that each is in, and its ``place`` there; the last batch may be shorter."""
    from hitwatch.operators.index import prefix_sum

    if size < 1:
        raise ValueError("a batch has at least one event")
    sizes = prefix_sum(file_sizes(spark, paths), [F.col("ord"), F.col("path")], {"rows": "end"}).select(F.col("path").alias("_file"), (F.col("end") - F.col("rows")).alias("_first"))
    bytes_ = sizes.agg(F.coalesce(F.sum(F.octet_length("_file") + 24), F.lit(0))).first()[0]
    df = spark.read.parquet(*paths)
    names = list(columns) if columns is not None else df.columns
    if clash := {"batch", "place"} & set(names):
        raise ValueError(f"columns are there already: {sorted(clash)}")
    rows = df.select(*[F.col(f"`{c}`") for c in names], _plain(F.col("_metadata.file_path")).alias("_own"), F.col("_metadata.row_index").alias("_row"))
    placed = rows.join(F.broadcast(sizes) if bytes_ <= BROADCAST_BYTES else sizes, F.col("_own") == F.col("_file"))
    at = F.col("_first") + F.col("_row")
    return placed.select(*[F.col(f"`{c}`") for c in names], F.floor(at / size).cast("long").alias("batch"), (at % size).cast("long").alias("place"))


class Slice(InputPartition):
    """Rows [first, last) of a file, whose row 0 has the place ``shift`` in the whole input."""

    def __init__(self, path: str, first: int, last: int, shift: int) -> None:
        self.path, self.first, self.last, self.shift = path, first, last, shift


class EventReader(DataSourceStreamReader):
    """Offsets are (file, row): what comes next. Each call for the newest offset admits ``size`` events more, until the files or batch ``last`` end."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.size = schema, int(options["size"])
        self.paths, self.rows = json.loads(options["paths"]), json.loads(options["rows"])
        self.firsts = [0, *accumulate(self.rows)]
        self.first, self.end = int(options.get("first", 0)) * self.size, min(int(options.get("last", self.firsts[-1])) * self.size, self.firsts[-1])
        self.at = self.initialOffset()

    def _place(self, offset: dict) -> int:
        return self.firsts[offset["file"]] + offset["row"]

    def _offset(self, place: int, file: int = 0) -> dict:
        """Offset of a place that lies in no file before ``file``."""
        while file < len(self.paths) and place >= self.firsts[file + 1]:
            file += 1
        return {"file": file, "row": place - self.firsts[file]}

    def initialOffset(self) -> dict:  # noqa: N802
        return self._offset(self.first) if self.first else {"file": 0, "row": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        at = self._place(self.at)
        self.at = self._offset(max(at, min(at + self.size, self.end)), self.at["file"])
        return self.at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = self._place(start), self._place(end)
        if last < first:
            raise ValueError(f"offset {end} lies before {start}, which has been read")
        # after a restart Spark plans the last batch of its log before it asks for a new offset: what that batch had has been admitted
        self.at = max(self.at, end, key=self._place)
        out = []
        for path, shift, rows in zip(self.paths, self.firsts, self.rows, strict=False):
            a, b = max(first - shift, 0), min(last - shift, rows)
            out += [Slice(path, i, min(i + SLICE, b), shift) for i in range(a, b, SLICE)]
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        import pyarrow.parquet as pq

        # a file's address as Hadoop writes it, with one slash after the scheme
        system, inner = pyarrow.fs.FileSystem.from_uri(partition.path.replace("file:/", "file:///") if partition.path.startswith("file:/") else partition.path)
        names = [f.name for f in self.schema.fields if f.name not in ("batch", "place")]
        with pq.ParquetFile(inner, filesystem=system) as file:
            begin = 0
            for group in range(file.num_row_groups):
                rows = file.metadata.row_group(group).num_rows
                a, b = max(partition.first - begin, 0), min(partition.last - begin, rows)
                if a < b:
                    table = file.read_row_group(group, columns=names).slice(a, b - a)
                    at = pa.array(range(partition.shift + begin + a, partition.shift + begin + b), pa.int64()).to_numpy()
                    own = {n: table[n] for n in names} | {"batch": pa.array(at // self.size), "place": pa.array(at % self.size)}
                    yield from pa.table([own[f.name] for f in self.schema.fields], names=self.schema.names).combine_chunks().to_batches()
                begin += rows


class EventBatchSource(DataSource):
    """Spark data source ``event_batches``; ``read_batches`` sets its options."""

    @classmethod
    def name(cls) -> str:
        return "event_batches"

    def streamReader(self, schema: StructType) -> EventReader:  # noqa: N802
        return EventReader(schema, self.options)


def read_batches(spark: SparkSession, paths: Sequence[str], schema: StructType, size: int = 512) -> DataFrame:
    """A stream of the events of Parquet files in which every micro-batch has exactly ``size`` events, the last one what is left.

    ``batch`` and ``place`` are added to ``schema``. A query that is started again goes on from its checkpoint; files may have been added to the end of
    the list since. The driver holds the list of files and their sizes, executors read the rows, each task a slice of one file. A slice costs the row groups that
    it lies in, which should be small for small batches. Paths must be ones that Arrow's file systems know (local, HDFS, S3, GCS).
    """
    return _stream(spark, _listed(spark, paths), schema, size)


def _listed(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """The files and their numbers of rows, as many as there are files."""
    return [(r["path"], r["rows"]) for r in file_sizes(spark, paths).orderBy("ord", "path").collect()]


def _stream(spark: SparkSession, files: Sequence[tuple[str, int]], schema: StructType, size: int, **stretch: int) -> DataFrame:
    if size < 1:
        raise ValueError("a batch has at least one event")
    spark.dataSource.register(EventBatchSource)
    whole = StructType([*schema.fields, StructField("batch", LongType()), StructField("place", LongType())])
    reader = spark.readStream.format("event_batches").schema(whole).option("paths", json.dumps([p for p, _ in files])).option("rows", json.dumps([n for _, n in files]))
    return reader.options(size=size, **stretch).load()


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Call ``work`` with every micro-batch and its number until the files end, then stop. A batch that failed or was cut off comes again with its number."""
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def _save(folder: str, first: int = 0) -> Callable[[DataFrame, int], None]:
    def save(batch: DataFrame, number: int) -> None:
        path = f"{folder}/arrival={first + number}"
        discard(batch.sparkSession, path)
        batch.write.parquet(path)

    return save


def _arrived(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("arrival", LongType())])).parquet(folder)


def to_table(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """All events of a stream with the micro-batch (``arrival``) in which they came; a batch that comes again replaces its rows."""
    run_batches(stream, _save(folder), checkpoint)
    return _arrived(stream.sparkSession, stream.schema, folder)


def side_by_side(spark: SparkSession, paths: Sequence[str], schema: StructType, size: int, folder: str, checkpoint: str, streams: int) -> DataFrame:
    """``to_table`` of ``read_batches`` by several streams at a time, each of which admits a stretch of the batches, one a micro-batch.

    A stream's micro-batches come one after the other, so one stream takes no less time on more machines. ``arrival`` counts on from the stretch's first
    batch. When it is started again the same ``streams`` and files must be given, as each stretch has a checkpoint of its own.
    """
    files = _listed(spark, paths)
    n = -(-sum(rows for _, rows in files) // size)
    streams = max(1, min(streams, n))
    queries, last = [], 0
    try:
        for i in range(streams):
            first, last = last, n * (i + 1) // streams
            made = _stream(spark, files, schema, size, first=first, last=last)
            queries.append(made.writeStream.foreachBatch(_save(folder, first)).option("checkpointLocation", f"{checkpoint}/{i}").start())
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
    return _arrived(spark, made.schema, folder)

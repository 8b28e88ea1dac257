import pytest
from pyspark.sql import functions as F

from hitwatch.operators.windows import Layout
from hitwatch.plans.queries import QUERIES
from hitwatch.sources import files
from hitwatch.streaming import jobs


def test_manifests_globs_and_urls(spark, tmp_path):
    for name in ("a1.parquet", "a2.parquet"):
        (tmp_path / name).write_text("")
    (tmp_path / "list.txt").write_text(f"# comment\n\n  {tmp_path}/a*.parquet \nroot://host//x.root\n{tmp_path}/none.parquet\n")
    got = [p.removeprefix("file:") for p in files.resolve_inputs(spark, str(tmp_path / "list.txt"))]
    assert got == [f"{tmp_path}/a1.parquet", f"{tmp_path}/a2.parquet", "root://host//x.root", f"{tmp_path}/none.parquet"]


def test_file_slice():
    assert files.file_slice(["a", "b", "c"], 1, 1) == ["b"] and files.file_slice(["a", "b"], 1) == ["b"]
    with pytest.raises(ValueError):
        files.file_slice(["a"], 1)


def test_missing_and_corrupt_files(spark, tmp_path):
    good, bad, gone = (str(tmp_path / n) for n in ("good.parquet", "bad.parquet", "gone.parquet"))
    spark.range(4).withColumn("w", F.array(F.array(F.col("id").cast("float")))).write.parquet(good)
    (tmp_path / "bad.parquet").write_text("not parquet")
    schema = spark.read.parquet(good).schema
    got = files.read_events(spark, [good, bad, gone], ["id", "w", "absent"], schema=schema, on_missing="skip")
    assert got.count() == 4 and got.columns == ["id", "w", "absent", "source_file"]
    assert files.flat_values(got, "w").count() == 4
    with pytest.raises(Exception, match="gone"):
        files.read_events(spark, [good, gone]).count()
    with pytest.raises(FileNotFoundError):
        files.read_events(spark, [gone], on_missing="skip")


def test_file_index(spark, tmp_path):
    spark.range(6).repartition(3).write.parquet(str(tmp_path / "t"))
    got = files.with_file_index(files.read_events(spark, [str(tmp_path / "t")])).select("source_file", "file_idx").distinct().orderBy("file_idx").collect()
    assert [r["file_idx"] for r in got] == list(range(len(got))) and [r["source_file"] for r in got] == sorted(r["source_file"] for r in got)


def test_event_store_round_trip(spark, tmp_path):
    events = spark.range(3).select(F.col("id").alias("event_idx"), F.col("id").alias("run"))
    hits = spark.range(5).select((F.col("id") % 3).alias("event_idx"), F.col("id").alias("pos"), F.col("id").alias("channel"), F.lit(1.0).alias("integral"))
    files.save_events(events, hits, str(tmp_path / "store"))
    e, h = files.load_events(spark, str(tmp_path / "store"))
    assert e.count() == 3 and h.count() == 5 and h.filter("time IS NULL").count() == 5 and "evt" in e.columns


def test_windows_scores_and_csv(spark, tmp_path):
    rows = spark.range(2).withColumnRenamed("id", "window_id")
    files.save_windows(rows, rows, {"size": 20}, str(tmp_path / "w"))
    w, m, settings = files.load_windows(spark, str(tmp_path / "w"))
    assert (w.count(), m.count(), settings) == (2, 2, {"size": "20"})
    files.save_scores(rows, rows, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "node_scores")).count() == 2
    files.write_csv(rows, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["window_id"]
    flat = files.flatten_bins(spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "bins array<array<double>>")).first()["bins"]
    assert flat == [1.0, 2.0, 3.0, 4.0]


def test_run_lists(spark, tmp_path):
    (tmp_path / "runs.json").write_text('{"good": [1, 2, 2],\n "bad": [3]}')
    assert sorted(tuple(r) for r in files.read_runs(spark, str(tmp_path / "runs.json")).collect()) == [(1, True), (2, True), (3, False)]


def test_stream_equals_batch(spark, tmp_path):
    raw = spark.range(20).select(F.col("id").alias("evt"), F.array(F.col("id").cast("double"), F.lit(1.0), F.lit(None).cast("double")).alias("w")).withColumn("w", F.filter("w", lambda x: x.isNotNull()))
    raw.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = jobs.event_vectors(jobs.read_stream(spark, str(tmp_path / "in"), raw.schema, files_per_batch=1), "w", 4).select("evt", "x", "repaired")
    jobs.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = jobs.event_vectors(raw, "w", 4).select("evt", "x", "repaired")
    assert spark.read.parquet(str(tmp_path / "out")).orderBy("evt").collect() == batch.orderBy("evt").collect()


def test_temporary_tables_go_with_their_block(spark):
    from hitwatch.sources import scratch

    with scratch.temporary(spark):
        stored = scratch.Stored(spark.range(3), "test")
        assert stored.df.count() == 3 and scratch.is_folder(spark, stored.path)
    at = spark._jvm.org.apache.hadoop.fs.Path(stored.path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from hitwatch.sources import scratch

    class Unset:
        def __init__(self, master):
            self.master, self.made = master, None
            self.conf = self.sparkContext = self

        def get(self, *_):
            return None

        def getConf(self):
            return self

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            self.made = path

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.shared_dir(Unset("spark://host:7077"))
    assert scratch.shared_dir(Unset("local[4]")).startswith("file:///")


@pytest.mark.parametrize("folder", [False, True])
def test_event_streams_read_both_layouts(spark, sf_dir, tmp_path, folder):
    """A single events.parquet among other tables, or a folder of part files of that name."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").limit(500)
    out = tmp_path / "events.parquet"
    if folder:
        events.repartition(3).write.parquet(str(out))
    else:
        events.coalesce(1).write.parquet(str(tmp_path / "made"))
        next((tmp_path / "made").glob("part-*.parquet")).rename(out)
    spark.range(3).write.parquet(str(tmp_path / "other.parquet"))
    assert spark.read.parquet(str(out)).count() == 500
    assert QUERIES["stream_vectors"](spark, str(tmp_path)).select("event_id").distinct().count() == 500
    assert QUERIES["stream_scores"](spark, str(tmp_path)).count() == 500

"""Streams that stop and start: frames on the state store, batches of a fixed number of events; and the bucketed event store."""

import re

import pytest
from pyspark.sql import functions as F

from hitwatch.operators.hits import channel_partials, hit_partials
from hitwatch.operators.windows import Layout, frame_features, frames_of_hits
from hitwatch.sources import event_batches, event_store
from hitwatch.streaming import frames, jobs
from tests.test_plans import plan_of

HITS = "event_idx long, channel long, integral double"


def hit_rows(spark, n=30):
    """Three hits an event, one of them on no channel."""
    return spark.range(3 * n).select(F.floor(F.col("id") / 3).cast("long").alias("event_idx"), F.when(F.col("id") % 10 != 9, F.col("id") % 4).alias("channel"), F.col("id").cast("double").alias("integral"))


def same(got, want):
    return sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


class Arrivals:
    """A folder that hits arrive in, and a stream of frames from it that is started anew for each arrival."""

    def __init__(self, spark, folder, layout, lateness=0):
        self.spark, self.folder, self.layout, self.lateness = spark, str(folder), layout, lateness

    def add(self, rows):
        rows.select("event_idx", "channel", "integral").coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        stream = jobs.read_stream(self.spark, f"{self.folder}/in", HITS, files_per_batch=1)
        return frames.run_frames(stream, self.layout, f"{self.folder}/out", f"{self.folder}/cp", self.lateness)

    def frames(self, n):
        return frames.whole_frames(self.spark, f"{self.folder}/out", self.layout, n)


def test_streamed_frames_equal_batch(spark, tmp_path):
    layout = Layout(3, 2, 1, 2)
    rows, a = hit_rows(spark), Arrivals(spark, tmp_path, layout)
    for first, last in ((0, 3), (4, 4), (5, 29)):
        a.add(rows.filter(F.col("event_idx").between(first, last)))
        query = a.run()
        open_frames = {f for e in range(30) for f in range(max(0, last - layout.size + 2), last + 1)}
        assert frames.state_size(query)[0] <= len(open_frames) and frames.dropped(query) == 0
    assert same(a.frames(30), frame_features(channel_partials(rows), layout, 30))


def test_a_batch_that_was_cut_off_comes_again(spark, tmp_path):
    """The log of finished batches loses its last entry, as when a query is killed between a batch's work and its commit."""
    rows, a = hit_rows(spark), Arrivals(spark, tmp_path, Layout(3, 3, 1, 1))
    a.add(rows.filter("event_idx < 10"))
    a.run()
    last = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    a.add(rows.filter("event_idx >= 10"))
    a.run()
    assert same(a.frames(30), frame_features(channel_partials(rows), a.layout, 30))


def test_late_events(spark, tmp_path):
    """Within ``lateness`` they count, however the batches cut them; later ones are left out and counted."""
    rows = hit_rows(spark)
    a = Arrivals(spark, tmp_path / "a", Layout(4, 4, 0, 2), lateness=6)
    for part in ("event_idx < 8 AND event_idx <> 5", "event_idx = 5 OR event_idx >= 8"):
        a.add(rows.filter(part))
        assert frames.dropped(a.run()) == 0
    got, want = a.frames(24), frame_features(channel_partials(rows), a.layout, 24)
    closed = F.col("frame_start") <= 29 - 6 - 4  # later ones are still open
    assert same(got.filter(closed), want.filter(closed))
    b = Arrivals(spark, tmp_path / "b", Layout(4, 4, 0, 2))
    b.add(rows.filter("event_idx BETWEEN 4 AND 9"))
    b.run()
    b.add(rows.filter("event_idx < 4 OR event_idx > 9"))
    assert frames.dropped(b.run()) > 0
    assert same(b.frames(28).filter("frame_start >= 4"), frame_features(channel_partials(rows), b.layout, 28).filter("frame_start >= 4"))


def test_partials_by_hit_merge_to_the_same_frames(spark):
    rows = hit_rows(spark).unionByName(hit_rows(spark)).unionByName(spark.createDataFrame([(1, 2, None), (1, -1, 5.0)], HITS))
    for layout in (Layout(5, 5, 1, 2), Layout(5, 2, 1, 2)):
        want = frame_features(channel_partials(rows), layout, 30)
        assert same(frame_features(hit_partials(rows), layout, 30), want.filter("cnt > 0")) and same(frames_of_hits(rows, layout, 30).filter("cnt > 0"), want.filter("cnt > 0"))


# --- batches of events ------------------------------------------------------------------------------------------


@pytest.fixture
def sources(spark, tmp_path):
    """Folders of 7, 0, 12 and 5 events, the third in two files with several row groups."""
    paths, at = [], 0
    for i, n in enumerate((7, 0, 12, 5)):
        rows = spark.range(at, at + n).select(F.col("id").alias("evt"), (F.col("id") * 2).alias("x"))
        path = f"{tmp_path}/s{i}"
        rows.repartitionByRange(2 if i == 2 else 1, "evt").sortWithinPartitions("evt").write.option("parquet.block.size", 64).parquet(path)
        paths.append(path)
        at += n
    return paths


@pytest.mark.parametrize("size", [1, 5, 24, 100])
def test_batches_go_over_file_borders(spark, sources, size):
    got = event_batches.with_batches(spark, sources, size, ["evt"])
    assert sorted(map(tuple, got.collect())) == [(i, i // size, i % size) for i in range(24)]
    assert "Exchange hashpartitioning" not in plan_of(got).replace("Exchange hashpartitioning(_part", "")
    with pytest.raises(ValueError, match="at least one"):
        event_batches.with_batches(spark, sources, 0)


def test_streams_admit_exactly_so_many_events(spark, sources, tmp_path):
    schema, cp = spark.read.parquet(sources[0]).schema, f"{tmp_path}/cp"
    sizes = []

    def count(batch, number):
        sizes.append((number, sorted(map(tuple, batch.select("evt", "x", "batch", "place").collect()))))
        if number == 2 and len(sizes) == 3:
            raise RuntimeError("cut off")

    with pytest.raises(Exception, match="cut off"):
        event_batches.run_batches(event_batches.read_batches(spark, sources, schema, 5), count, cp)
    event_batches.run_batches(event_batches.read_batches(spark, sources, schema, 5), count, cp)
    event_batches.run_batches(event_batches.read_batches(spark, sources, schema, 5), count, cp)  # nothing is left
    # the batch that was cut off comes again with its number and rows; no other does
    assert [n for n, _ in sizes] == [0, 1, 2, 2, 3, 4] and sizes[2] == sizes[3]
    assert dict(sizes) == {b: [(i, 2 * i, b, i % 5) for i in range(5 * b, min(5 * b + 5, 24))] for b in range(5)}


def test_a_stream_goes_on_with_files_added_since(spark, sources, tmp_path):
    schema, cp, seen = spark.read.parquet(sources[0]).schema, f"{tmp_path}/cp", []
    work = lambda batch, number: seen.append([r["evt"] for r in batch.orderBy("evt").collect()])
    for paths in (sources[:1], sources):
        event_batches.run_batches(event_batches.read_batches(spark, paths, schema, 5), work, cp)
    assert seen == [list(range(a, b)) for a, b in ((0, 5), (5, 7), (7, 12), (12, 17), (17, 22), (22, 24))]


def test_no_event_is_read_twice():
    reader = event_batches.EventReader(None, {"size": "3", "paths": '["a", "b"]', "rows": "[4, 5]"})
    at, offsets = reader.initialOffset(), []
    while (new := reader.latestOffset()) != at:
        offsets.append((new["file"], new["row"]))
        at = new
    assert offsets == [(0, 3), (1, 2), (2, 0)]
    with pytest.raises(ValueError, match="has been read"):
        reader.partitions({"file": 1, "row": 0}, {"file": 0, "row": 3})


# --- event store ------------------------------------------------------------------------------------------------


@pytest.fixture
def stored(spark, tmp_path):
    events = spark.range(40).select(F.col("id").alias("event_idx"), (F.col("id") * 3).alias("evt"), F.lit(1).cast("long").alias("run"))
    hits = hit_rows(spark, 40).filter("event_idx % 7 <> 3").withColumn("time", F.lit(0.5))
    event_store.save(events, hits, f"{tmp_path}/store", per_bucket=8)
    return f"{tmp_path}/store", hits


def test_store_holds_every_event_and_hit(spark, stored):
    path, hits = stored
    rows = event_store.load(spark, path)
    assert [(r["event_idx"], r["evt"]) for r in rows.orderBy("event_idx").collect()] == [(i, 3 * i) for i in range(40)]
    assert same(event_store.hits_of(rows), hits.select("event_idx", "channel", "integral", "time"))
    assert rows.filter(F.size("hits") == 0).count() == sum(i % 7 == 3 for i in range(40))


def test_a_range_reads_its_buckets_alone(spark, stored):
    path, hits = stored
    layout = Layout(4, 4, 1, 2)
    part = event_store.load_windows(spark, path, layout, 3, 4)  # events 12 to 23
    assert sorted(r["event_idx"] for r in part.select("event_idx").collect()) == list(range(12, 24))
    plan = plan_of(part)
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*event_idx", plan)
    made = frames_of_hits(event_store.hits_of(part), layout, 40)
    # no join with an index, and one exchange: that of the frames
    assert len(re.findall("Exchange", plan_of(made))) == 1 and "Join" not in plan_of(made)
    want = frame_features(channel_partials(hits), layout, 40)
    whole = F.col("frame_start").between(12, 20)
    assert same(made.filter(whole), want.filter(whole))


def test_store_is_written_with_one_exchange(spark, tmp_path, monkeypatch):
    """What is written comes from one exchange, by ranges of the event index, in which events and hits meet."""
    plans = []
    writer = type(spark.range(0).write)
    real = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, path, *a, **k: (plans.append(plan_of(self._df)), real(self, path, *a, **k))[1])
    event_store.save(spark.range(9).select(F.col("id").alias("event_idx"), F.col("id").alias("evt")), hit_rows(spark, 9), f"{tmp_path}/store")
    assert len(re.findall("Exchange", plans[0])) == 1 and "rangepartitioning(event_idx" in plans[0] and "Join" not in plans[0]


def test_saved_windows_are_pruned_by_their_partition(spark, tmp_path):
    from hitwatch.sources import files

    made = spark.range(100).select(F.col("id").alias("window_id"), F.lit(1).alias("channel"), F.floor(F.col("id") / 25).alias("window_range"))
    files.save_windows(made, spark.range(1), {"a": 1}, f"{tmp_path}/w", partition_by="window_range")
    rows, _, settings = files.load_windows(spark, f"{tmp_path}/w")
    part = rows.filter("window_range = 2")
    assert re.search(r"PartitionFilters: \[[^]]*window_range", plan_of(part)) and settings == {"a": "1"}
    assert sorted(r["window_id"] for r in part.collect()) == list(range(50, 75))


def test_a_range_of_saved_windows_has_one_file(spark, sf_dir, tmp_path, monkeypatch):
    """However many tasks there are: files would be tasks x ranges else."""
    from hitwatch.plans import queries

    monkeypatch.setattr(queries, "scratch", lambda spark, label: f"file://{tmp_path}/{label}")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plan = plan_of(queries.QUERIES["saved_windows"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = list((tmp_path / "saved" / "windows").glob("window_range=*"))
    assert ranges and all(len(list(r.glob("*.parquet"))) == 1 for r in ranges)
    # metadata come before the bins become rows
    assert not re.search("Exchange|Join", plan.partition("posexplode")[0])


@pytest.mark.parametrize("streams", [1, 2, 9])
def test_streams_side_by_side_admit_the_same_batches(spark, sources, tmp_path, streams):
    """Each micro-batch of each stream has exactly ``size`` events; those that were done do not come again."""
    schema = spark.read.parquet(sources[0]).schema
    for _ in range(2):
        got = event_batches.side_by_side(spark, sources, schema, 5, f"{tmp_path}/rows", f"{tmp_path}/cp", streams)
    assert sorted(map(tuple, got.select("evt", "x", "batch", "place", "arrival").collect())) == [(i, 2 * i, i // 5, i % 5, i // 5) for i in range(24)]
    commits = [len([f for f in c.iterdir() if f.name.isdigit()]) for c in tmp_path.glob("cp/*/commits")]
    assert len(commits) == min(streams, 5) and sum(commits) == 5 and max(commits) - min(commits) <= 1


def test_streamed_events_lie_in_small_row_groups(spark, tmp_path, monkeypatch):
    """A micro-batch reads its row groups whole: with a file in one group, each of them would read the file."""
    import pyarrow.parquet as pq

    from hitwatch.plans import fixtures, source_queries

    events = spark.range(400_000).select(F.lit(1).alias("run"), (F.col("id") * 7).alias("evt"))
    monkeypatch.setattr(fixtures, "events", lambda spark, sf_dir: events)
    monkeypatch.setattr(source_queries, "scratch", lambda spark, label: f"file://{tmp_path}/{label}")
    source_queries._sorted_files(spark, "")
    (file,) = (tmp_path / "sources" / "file=0").glob("*.parquet")
    kept = pq.ParquetFile(file).metadata
    assert kept.num_rows == 400_000 and max(kept.row_group(i).num_rows for i in range(kept.num_row_groups)) < 300_000

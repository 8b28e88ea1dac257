import random

import pytest
from pyspark.sql import functions as F

from hitwatch.operators import graph, hits, index, score, windows
from hitwatch.operators.windows import Layout


def events_and_hits(spark, sizes, channels, seed=0):
    rng = random.Random(seed)
    hit_rows = [(e, rng.randrange(channels), round(rng.random(), 3)) for e, n in enumerate(sizes) for _ in range(n)]
    return len(sizes), hit_rows, spark.createDataFrame(hit_rows, "event_idx long, channel long, integral double")


def naive(rows, layout, n):
    """Features of used frames by looping over windows."""
    out = {}
    for k in range(layout.count(n)):
        for w in range(layout.history + 1):
            start = k * layout.stride + w * layout.size
            q, r = divmod(layout.size, layout.bins)
            edges, at = [], 0
            for b in range(layout.bins):
                edges.append((at, at + q + (b < r)))
                at = edges[-1][1]
            for b, (lo, hi) in enumerate(edges):
                cells = {}
                for e, c, x in rows:
                    if start + lo <= e < start + hi:
                        cells.setdefault(c, []).append(x)
                out |= {(start, c, b): (round(sum(v), 6), len(v), min(v), max(v)) for c, v in cells.items()}
    return out


@pytest.mark.parametrize(("size", "stride", "history", "bins"), [(4, 1, 2, 2), (4, 3, 1, 3), (3, 7, 1, 2), (2, 2, 0, 4), (5, 5, 2, 1)])
def test_frames_equal_a_plain_loop(spark, size, stride, history, bins):
    layout = Layout(size, stride, history, bins)
    n, rows, df = events_and_hits(spark, [random.Random(3).randrange(6) for _ in range(30)], 5)
    got = windows.frame_features(hits.channel_partials(df), layout, n).collect()
    assert {(r["frame_start"], r["channel"], r["bin"]): (round(r["sum"], 6), r["cnt"], r["min"], r["max"]) for r in got} == naive(rows, layout, n)
    assert all(r["stdev"] >= 0 for r in got)


def test_window_counts():
    assert Layout(4, 1, 2, 2).count(40) == 29
    assert Layout(4, 2, 2, 2).count(40) == 15
    assert Layout(2, 1, 1, 2).count(16) == 13
    assert Layout(20, 5, 4).count(10) == 0
    with pytest.raises(ValueError):
        Layout(0, 1)


@pytest.mark.parametrize(("size", "bins", "want"), [(5, 2, [0, 0, 0, 1, 1]), (2, 4, [0, 1]), (20, 4, [i // 5 for i in range(20)])])
def test_bins(spark, size, bins, want):
    assert [r[0] for r in spark.range(size).select(windows.bin_of(F.col("id"), size, bins)).collect()] == want


def test_unknown_feature():
    with pytest.raises(ValueError, match="median"):
        windows.check_features(["sum", "median"])


def test_empty_events_keep_their_place(spark):
    n, _, df = events_and_hits(spark, [0, 5, 0, 3, 0, 7, 0, 4, 0, 6, 0, 8, 0, 2, 0, 5], 8, 2)
    layout = Layout(2, 1, 1, 2)
    rows = graph.assemble(windows.frame_features(hits.channel_partials(df), layout, n), layout, layout.count(n))
    assert rows.select("window_id").distinct().count() == 13
    nodes = graph.active_nodes(rows, layout, 13)
    vectors = graph.node_vectors(graph.node_cells(rows, layout, 13), layout).collect()
    assert {len(v["x"]) for v in vectors} == {1 + 2 * 5} and {len(v["y"]) for v in vectors} == {2 * 5}


def test_idle_window_falls_back_to_channel_zero(spark):
    layout = Layout(2, 2, 1, 1)
    df = spark.createDataFrame([(3, 4, 1.0)], "event_idx long, channel long, integral double")
    rows = graph.assemble(windows.frame_features(hits.channel_partials(df), layout, 6), layout, layout.count(6))
    nodes = graph.active_nodes(rows, layout, layout.count(6))
    assert sorted((r["window_id"], r["channel"]) for r in nodes.collect()) == [(0, 0), (1, 4)]
    # the only hit is in the target of window 0, so its fallback node scores 0 there
    scores = {r["window_id"]: r["mse"] for r in score.forecast_node_scores(rows, layout, layout.count(6)).collect()}
    assert scores[0] == 0 and scores[1] > 0


def test_band_edges(spark):
    assert graph.band_edges(spark, 5, 1).count() == 13
    n, r = 50, 4
    assert graph.band_edges(spark, n, r).count() == n * (2 * r + 1) - r * (r + 1)


def test_scores_mean_at_most_max(spark):
    n, _, df = events_and_hits(spark, [7] * 24, 6, 5)
    layout = Layout(4, 2, 2, 2)
    rows = graph.assemble(windows.frame_features(hits.channel_partials(df), layout, n), layout, layout.count(n))
    got = score.window_scores(score.forecast_node_scores(rows, layout, layout.count(n))).collect()
    assert len(got) == layout.count(n) and all(0 <= r["score_mean"] <= r["score_max"] for r in got)


def test_order_is_independent_of_partitions(spark):
    rows = [(r, s, e, 0, i) for i, (r, s, e) in enumerate((r, s, e) for r in (2, None, 1) for s in (1, 0) for e in range(5))]
    df = spark.createDataFrame(rows, "run long, subrun long, evt long, file_idx long, entry long")
    want = sorted(rows, key=lambda t: tuple(999999999 if x is None else x for x in t))
    for parts in (1, 7):
        got = index.order_events(df.repartition(parts)).orderBy("event_idx").collect()
        assert [r["event_idx"] for r in got] == list(range(len(rows))) and [tuple(r)[:5] for r in got] == want


def test_prefix_sum(spark):
    df = spark.range(100).withColumn("n", F.col("id") % 7).repartition(5)
    got = index.prefix_sum(df, [F.col("id")], {"n": "end"}).orderBy("id").collect()
    total = 0
    for r in got:
        total += r["n"]
        assert r["end"] == total


def test_signal_windows(spark):
    df = spark.range(256).select(F.col("id").alias("t"), F.col("id").cast("double").alias("v"), F.lit(0).alias("label"))
    got = windows.signal_windows(df, 64, 32, 256).collect()
    assert len(got) == 7 and all(len(r["values"]) == 64 and r["values"][0] == r["window_id"] * 32 for r in got)
    assert Layout(64, 1).count(1000) == 937


def test_missing_plane_is_skipped(spark):
    df = spark.createDataFrame([(1, [3, -1], [1.0, 2.0], [4], [5.0])], "evt long, c0 array<long>, q0 array<double>, c1 array<long>, q1 array<double>")
    got = hits.explode_hits(df, [{"channel": "c0", "integral": "q0"}, {"channel": "cX", "integral": "q1"}, {"channel": "c1", "integral": "q1"}], ["evt"]).orderBy("pos").collect()
    assert [(r["plane_ord"], r["channel"], r["integral"]) for r in got] == [(0, 3, 1.0), (1, 4, 5.0)]


def test_concat_metadata(spark):
    df = spark.createDataFrame([(1, [2.0, 3.0], None), (None, None, 4)], "run long, more array<double>, last int")
    got = hits.concat_metadata(df, ["run", "absent", "more", "last"]).collect()
    assert [r["meta_values"] for r in got] == [[1.0, 2.0, 3.0], [4.0]]


def test_first_windows_only(spark):
    layout = Layout(4, 2, 1)
    assert [tuple(r) for r in windows.windows(spark, layout, 20, max_windows=2).collect()] == [(0, 0, 7), (1, 2, 9)]
    assert windows.windows(spark, layout, 7).count() == 0 and windows.windows(spark, layout, 20).count() == 7


def test_results_do_not_depend_on_shuffle_partitions(spark):
    n, _, df = events_and_hits(spark, [5] * 30, 6, 9)
    layout, before, seen = Layout(4, 3, 1, 2), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = graph.assemble(windows.frame_features(hits.channel_partials(df), layout, n), layout, layout.count(n))
            scores = score.forecast_node_scores(rows, layout, layout.count(n))
            seen.append(sorted((r["window_id"], r["channel"], round(r["mse"], 9)) for r in scores.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and seen[0]


def test_scored_nodes_are_the_active_ones(spark):
    n, _, df = events_and_hits(spark, [random.Random(1).randrange(2) for _ in range(40)], 9, 4)
    layout = Layout(3, 2, 1, 2)
    rows = graph.assemble(windows.frame_features(hits.channel_partials(df), layout, n), layout, layout.count(n))
    pick = lambda d: sorted((r["window_id"], r["channel"]) for r in d.select("window_id", "channel").collect())
    nodes = graph.active_nodes(rows, layout, layout.count(n))
    assert pick(nodes) == pick(score.forecast_node_scores(rows, layout, layout.count(n)))
    assert {r["window_id"] for r in nodes.collect()} == set(range(layout.count(n)))


def test_files_keep_the_order_of_their_first_event(spark):
    df = spark.createDataFrame([(0, 7), (1, 3), (2, 7), (3, 1)], "event_idx long, file_idx long")
    assert [tuple(r) for r in windows.files_first_seen(df).orderBy("first_event").collect()] == [(7, 0), (3, 1), (1, 3)]


def test_history_runs_over_all_windows_hits_or_not(spark):
    """Windows without hits still start samples and count: starts are 0, stride, ... below the number of windows less the history."""
    for n, history, stride in ((5, 1, 1), (9, 3, 2), (4, 3, 1), (3, 3, 1), (0, 2, 1)):
        got = sorted(map(tuple, windows.history_pairs(spark, n, history, stride).collect()))
        assert got == [(i, lag, start + lag) for i, start in enumerate(range(0, n - history, stride)) for lag in range(history + 1)]


def test_idle_window_keeps_its_target_cells(spark):
    layout = Layout(2, 2, 1, 1)
    df = spark.createDataFrame([(3, 0, 5.0), (3, 4, 1.0)], "event_idx long, channel long, integral double")
    rows = graph.assemble(windows.frame_features(hits.channel_partials(df), layout, 6), layout, layout.count(6))
    got = {(r["window_id"], r["channel"]): r for r in graph.node_vectors(graph.node_cells(rows, layout, 2), layout).collect()}
    # window 0 has no past hit, so channel 0 stands in, with its real target; window 1 has both channels
    assert set(got) == {(0, 0), (1, 0), (1, 4)} and got[0, 0]["y"][0] == 5.0 and got[1, 4]["x"][1] == 1.0 and got[1, 4]["y"] == [0.0] * 5


def test_cells_agree_with_active_nodes(spark):
    n, _, df = events_and_hits(spark, [3, 0, 5, 2, 6, 1, 4, 0, 7, 3, 2, 5], 9, 4)
    layout = Layout(2, 1, 2, 2)
    rows = graph.assemble(windows.frame_features(hits.channel_partials(df), layout, n), layout, layout.count(n))
    a = graph.active_nodes(rows, layout, layout.count(n)).collect()
    b = graph.node_cells(rows, layout, layout.count(n)).drop("cells").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


@pytest.mark.parametrize("partials", [1, 1 << 15])
@pytest.mark.parametrize("layout", [Layout(20, 7, 4, 3), Layout(6, 1, 0, 4), Layout(9, 2, 1, 2), Layout(7, 10, 9, 1)])
def test_overlapping_frames_over_several_blocks(spark, monkeypatch, layout, partials):
    monkeypatch.setattr(windows, "FRAMES", 2)
    monkeypatch.setattr(windows, "PARTIALS", partials)
    n, rows, df = events_and_hits(spark, [random.Random(i).randrange(4) for i in range(150)], 5, 7)
    got = windows.frame_features(hits.channel_partials(df), layout, n)
    assert layout.overlap > 2 and {(r["frame_start"], r["channel"], r["bin"]): (round(r["sum"], 6), r["cnt"], r["min"], r["max"]) for r in got.collect()} == naive(rows, layout, n)
    assert got.count() == got.select("frame_start", "channel", "bin").distinct().count()

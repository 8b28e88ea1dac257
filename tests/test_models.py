"""Model kinds and the one pass over windows' graphs, against plain loops over their rows."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitwatch.operators import graph, hits, predict, window_pass, windows
from hitwatch.operators.windows import Layout
from hitwatch.plans.queries import LAYOUT, Graph
from tests.test_plans import plan_of

DEEP = "i int, x array<array<double>>"


def test_kinds_take_their_shapes(spark):
    with pytest.raises(ValueError, match="unknown model type"):
        predict.Model("rnn", lambda x: x)
    flat = spark.createDataFrame([(1, [1.0, 2.0])], "i int, x array<double>")
    for kind, columns in (("fusion", ["x"]), ("tpc", ["x", "x"]), ("gnn", ["x"])):
        with pytest.raises(ValueError, match="takes"):
            predict.Model(kind, lambda x: x).scores(flat, *columns)
    with pytest.raises(ValueError, match="takes columns"):
        predict.Model("pmt", lambda x: x).node_scores(flat, Layout(2, 2), 1)
    with pytest.raises(ValueError, match="threshold"):
        predict.Model("pmt", lambda x: x).flag(F.col("x"))
    assert [r["f"] for r in flat.select(predict.Model("pmt", abs, threshold=1.0).flag(F.col("i").cast("double")).alias("f")).collect()] == [False]


def test_windows_of_several_shapes(spark):
    rows = [(0, [[1.0, 2.0, 4.0], [0.0, 0.0, 0.0]]), (1, [[5.0, 5.0]]), (2, None), (3, [[2.0, 0.0, 1.0], [1.0, 1.0, 3.0]]), (4, [])]
    seen = []

    def fn(x):
        assert x.ndim == 3
        return x[..., ::-1]

    got = {r["i"]: r["score"] for r in predict.Model("window", fn).scores(spark.createDataFrame(rows, DEEP).coalesce(1), "x").collect()}
    for i, x in rows:
        if not x:
            assert got[i] is None or np.isnan(got[i])
        else:
            seen.append(i)
            assert got[i] == pytest.approx(np.mean((np.array(x) - np.array(x)[:, ::-1]) ** 2))
    assert seen == [0, 1, 3]
    back = {r["i"]: r["x_hat"] for r in predict.Model("window", fn).reconstruct(spark.createDataFrame(rows, DEEP), "x").collect()}
    assert back[0] == [[4.0, 2.0, 1.0], [0.0, 0.0, 0.0]] and back[2] is None and back[1] == [[5.0, 5.0]]


def test_plain_lists_are_windows_of_one_channel(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0]), (1, None)], "i int, x array<double>")
    model = predict.Model("window", lambda x: np.zeros_like(x) + x.shape[1])
    assert [(r["score"], r["x_hat"]) for r in model.reconstruct(model.scores(df, "x"), "x").orderBy("i").collect()] == [(2.0, [1.0, 1.0]), (None, None)]


def test_channels_of_unequal_length_are_refused(spark):
    with pytest.raises(Exception, match="one length"):
        predict.Model("window", lambda x: x).scores(spark.createDataFrame([(0, [[1.0, 2.0], [3.0]])], DEEP), "x").collect()


def test_fusion_and_z_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist(), rng.normal(size=2 + i % 2).tolist()) for i in range(20)] + [(20, None, [1.0]), (21, [1.0], None), (22, [2.0, 2.0, 2.0], [1.0, 3.0])]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>").repartition(3)
    fn = lambda a, b: np.concatenate([0.5 * a, b + 1], axis=1)
    z = lambda v: (v - v.mean()) / (v.std() or 1)
    for normalise in (False, True):
        got = {r["i"]: r["score"] for r in predict.Model("fusion", fn, normalise=normalise).scores(df, "a", "b").collect()}
        for i, a, b in rows:
            if a is None or b is None:
                assert got[i] is None
                continue
            a, b = (z(np.array(v)) if normalise else np.array(v) for v in (a, b))
            assert got[i] == pytest.approx(np.mean(np.concatenate([0.5 * a, -np.ones(len(b))]) ** 2))


def assembled_rows(seed, n_windows, layout, channels):
    """Sparse rows by window, among them windows without rows, or with rows of the target alone."""
    rng = np.random.default_rng(seed)
    rows = {}
    for window in range(n_windows):
        if window % 5 == 3:
            continue
        for _ in range(int(rng.integers(1, 30))):
            w = layout.history if window % 5 == 4 else int(rng.integers(0, layout.history + 1))
            rows[window, int(rng.integers(0, channels)), w, int(rng.integers(0, layout.bins))] = rng.normal(size=2).round(3).tolist()
    return rows


def plain_windows(rows, n_windows, layout, radius):
    """Nodes of each window: (channel, x, y, neighbours' places)."""
    for window in range(n_windows):
        cells = defaultdict(dict)
        for (k, channel, w, b), v in rows.items():
            if k == window:
                cells[channel][w, b] = v
        active = sorted(c for c, v in cells.items() if sum(abs(x) for (w, _), f in v.items() if w < layout.history for x in f) > 1e-6) or [0]
        dense = lambda c, w: [x for b in range(layout.bins) for x in cells[c].get((w, b), [0.0, 0.0])]
        x = [[i / max(len(active) - 1, 1)] + [v for w in range(layout.history) for v in dense(c, w)] for i, c in enumerate(active)]
        near = [[j for j, d in enumerate(active) if abs(c - d) <= radius] for c in active]
        yield window, active, np.array(x), np.array([dense(c, layout.history) for c in active]), near


@pytest.mark.parametrize(("block", "layout"), [(1, Layout(5, 5, 3, 2)), (40, Layout(5, 2, 1, 1)), (1 << 15, Layout(5, 5, 2, 3))])
def test_one_pass_equals_loops(spark, monkeypatch, block, layout):
    monkeypatch.setattr(window_pass, "BLOCK", block)
    n, radius, names = 23, 2, ("sum", "cnt")
    rows = assembled_rows(block, n, layout, 14)
    df = spark.createDataFrame([(*k, *v) for k, v in rows.items()], "window_id long, channel long, w long, bin long, sum double, cnt double")
    model = lambda x, edges, own: x[:, -2 * layout.bins :] + np.bincount(edges[1], weights=x[edges[0], 0], minlength=len(x))[:, None] + 0 * own[:, None]
    scored = {(r["window_id"], r["channel"]): r for r in predict.Model("gnn", model).node_scores(df, layout, n, features=names, radius=radius).collect()}
    means = {(r["window_id"], r["channel"]): r["mse"] for r in window_pass.neighbour_forecast(df, layout, n, features=names, radius=radius).collect()}
    frames = defaultdict(dict)
    for r in window_pass.propagated_frames(df, layout, n, layers=2, features=names, radius=radius).collect():
        frames[r["window_id"], r["channel"]][r["w"], r["bin"]] = [r["sum"], r["cnt"]]
    seen = 0
    for window, active, x, y, near in plain_windows(rows, n, layout, radius):
        last = x[:, 1 + (layout.history - 1) * layout.bins * 2 :]
        hop = lambda v: np.array([sum(v[j] / np.sqrt(len(near[j]) * len(near[i])) for j in near[i]) for i in range(len(active))])  # noqa: E731, B023
        twice = hop(hop(x[:, 1:]))
        for i, c in enumerate(active):
            told = x[i, -2 * layout.bins :] + sum(x[j, 0] for j in near[i])
            assert scored[window, c]["mse"] == pytest.approx(np.mean((told - y[i]) ** 2)) and scored[window, c]["node_rank"] == i
            assert means[window, c] == pytest.approx(np.mean((np.mean(last[near[i]], axis=0) - y[i]) ** 2))
            got = [v for w in range(layout.history) for b in range(layout.bins) for v in frames[window, c][w, b]]
            np.testing.assert_allclose(got, twice[i], atol=1e-9)
            seen += 1
    assert len(scored) == len(means) == len(frames) == seen


def test_edges_equal_the_table_of_edges(spark, sf_dir):
    g = Graph(spark, sf_dir)
    work = lambda b: (b.window[b.edges[1]], b.channel[b.edges[0]], b.channel[b.edges[1]])
    got = window_pass.window_pass(g.rows, LAYOUT, g.n, work, "window_id long, src_channel long, dst_channel long", radius=4)
    want = graph.pruned_edges(g.nodes, 4).select("window_id", "src_channel", "dst_channel")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()


def test_one_exchange_by_window(spark, sf_dir):
    g = Graph(spark, sf_dir)
    for df in (predict.Model("gnn", lambda x, e, own: x).node_scores(g.rows, LAYOUT, g.n), window_pass.neighbour_forecast(g.rows, LAYOUT, g.n), window_pass.propagated_frames(g.rows, LAYOUT, g.n)):
        plan = plan_of(df)
        assert len(re.findall(r"Exchange", plan)) == 1 and not re.search("Join|Cartesian|Aggregate", plan)


@pytest.mark.parametrize("block", [1, 1 << 15])
@pytest.mark.parametrize("layout", [Layout(5, 5, 3, 2), Layout(5, 2, 1, 1), Layout(2, 7, 1, 3), Layout(3, 1, 0, 2)])
def test_hits_are_assembled_in_their_task(spark, monkeypatch, block, layout):
    """One exchange, of hits; the blocks are those of assembled frames, with idle windows, windows over several ranges and no negative channels."""
    monkeypatch.setattr(window_pass, "BLOCK", block)
    rng, n = np.random.default_rng(block), 200
    rows = [(int(e), int(c), float(x)) for e, c, x in zip(rng.integers(0, 90, 300), rng.integers(-1, 12, 300), rng.integers(1, 50, 300), strict=True)]
    df = spark.createDataFrame([*rows, (3, 2, None)], "event_idx long, channel long, integral double")
    work = lambda b: (b.window, b.channel, b.rank, b.x.sum(axis=1), (b.x * np.arange(b.x.shape[1])).sum(axis=1), b.y.sum(axis=1))
    schema, names, count = "window_id long, channel long, node_rank long, s double, t double, y double", ("sum", "cnt", "min", "max", "mean", "stdev"), layout.count(n)
    got = window_pass.hit_pass(df, layout, n, work, schema, features=names)
    assert len(re.findall("Exchange", plan_of(got))) == 1 and "Join" not in plan_of(got)
    frames = windows.frame_features(hits.hit_partials(df), layout, n)
    want = window_pass.window_pass(graph.assemble(frames, layout, count), layout, count, work, schema, features=names)
    rounded = lambda d: sorted((r[0], r[1], r[2], *[round(v, 6) for v in r[3:]]) for r in d.collect())
    assert rounded(got) == rounded(want) and {r["window_id"] for r in got.collect()} == set(range(count))

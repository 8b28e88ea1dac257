"""Registered queries over the star-schema fixtures, one or more for each family of operators, with DuckDB twins."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitwatch.functions import vectors as vec
from hitwatch.operators import ablation, geometry, graph, hits, index, metrics, predict, score, splits, window_pass, windows
from hitwatch.operators.windows import Layout
from hitwatch.plans import fixtures as fx
from hitwatch.plans import source_queries  # noqa: F401  registers its queries
from hitwatch.plans.registry import ORACLE, QUERIES, query, rounded, slots
from hitwatch.sources import files
from hitwatch.sources.scratch import Stored, is_folder, scratch
from hitwatch.streaming import frames, jobs

__all__ = ["ORACLE", "QUERIES"]

LAYOUT = Layout(size=20, stride=20, history=4, bins=4)
RADIUS = 4
CELLS = LAYOUT.bins * len(windows.DEFAULT_FEATURES)


#: Added before rounding where values are often exact halves, which the two engines round differently.
NUDGE = 1.7e-8


def nudged(df: DataFrame, name: str) -> DataFrame:
    return rounded(df.withColumn(name, F.col(name) + NUDGE), name)


# --- order and hits ---------------------------------------------------------------------------------------------


@query(f"WITH {fx.SQL_HITS} SELECT run, subrun, evt, file_idx, entry, event_idx FROM idx")
def event_index(spark, sf_dir):
    return index.order_events(fx.events(spark, sf_dir)).select("run", "subrun", "evt", "file_idx", "entry", "event_idx")


@query(f"""WITH {fx.SQL_HITS}, c AS (SELECT event_idx, (SELECT count(*) FROM hit h WHERE h.evt = idx.evt) AS n_hits FROM idx)
SELECT event_idx, n_hits, (sum(n_hits) OVER (ORDER BY event_idx) - n_hits)::BIGINT AS "begin", (sum(n_hits) OVER (ORDER BY event_idx))::BIGINT AS "end" FROM c""")
def csr_offsets(spark, sf_dir):
    return index.csr_offsets(index.order_events(fx.events(spark, sf_dir)), fx.hits(spark, sf_dir))


@query(f"WITH {fx.SQL_HITS} SELECT event_idx, channel, sum(integral) AS sum, count(*) AS cnt, min(integral) AS min, max(integral) AS max, sum(integral * integral) AS sum_sq FROM ih GROUP BY ALL")
def event_channel_partials(spark, sf_dir):
    return hits.channel_partials(fx.Prepared(spark, sf_dir).hits)


@query(f"""WITH {fx.SQL_LINES} SELECT evt, 0 AS plane_ord, row_number() OVER (PARTITION BY evt ORDER BY i) - 1 AS pos, channel, l_quantity AS integral FROM lines WHERE i < n - 1 AND channel >= 0""")
def hit_clean_zip(spark, sf_dir):
    rows = fx.ragged(spark, sf_dir).withColumn("short", F.slice("quantity", F.lit(1), F.greatest(F.size("quantity") - 1, F.lit(0))))
    return hits.explode_hits(rows, [{"channel": "channel", "integral": "short"}, {"channel": "absent", "integral": "short"}], ["evt"])


# --- frames and windows -----------------------------------------------------------------------------------------


def _frames_sql(layout: Layout) -> str:
    return f"WITH {fx.sql_frames(layout)} SELECT frame_start, channel, bin, sum, cnt, round(mean, 6) AS mean, min, max, round(stdev, 6) AS stdev FROM frames"


def _frames(spark, sf_dir, layout: Layout) -> DataFrame:
    return rounded(fx.Prepared(spark, sf_dir).frames(layout), "mean", "stdev")


@query(_frames_sql(LAYOUT))
def frame_features(spark, sf_dir):
    return _frames(spark, sf_dir, LAYOUT)


@query(_frames_sql(Layout(20, 7, 4, 3)))
def frame_features_stride7(spark, sf_dir):
    return _frames(spark, sf_dir, Layout(20, 7, 4, 3))


@query(_frames_sql(Layout(20, 30, 4, 24)))
def frame_features_stride30(spark, sf_dir):
    return _frames(spark, sf_dir, Layout(20, 30, 4, 24))


@query(f"""WITH {fx.sql_frames(Layout(20, 20, 0, 4))} SELECT window_id, channel, bin, sum, cnt, round(mean, 6) AS mean, min, max, round(stdev, 6) AS stdev FROM asm""")
def dense_window_features(spark, sf_dir):
    p = fx.Prepared(spark, sf_dir)
    return rounded(windows.dense_window_features(p.hits, Layout(20, 20, 0, 4), p.n), "mean", "stdev")


@query(f"""WITH {fx.sql_frames(LAYOUT)} SELECT window_id, a.event_idx AS start, b.event_idx AS "end", a.run AS first_run, a.subrun AS first_subrun, a.evt AS first_evt, b.evt AS last_evt, a.file_idx AS first_file, b.file_idx AS last_file
FROM wins JOIN idx a ON a.event_idx = window_id * 20 JOIN idx b ON b.event_idx = window_id * 20 + 99""")
def window_provenance(spark, sf_dir):
    p = fx.Prepared(spark, sf_dir)
    return windows.provenance(spark, p.events, LAYOUT, p.n)


@query(f"WITH {fx.SQL_HITS} SELECT file_idx, min(event_idx) AS first_event FROM idx GROUP BY file_idx")
def files_first_seen(spark, sf_dir):
    return windows.files_first_seen(fx.Prepared(spark, sf_dir).events)


@query("""WITH s AS (SELECT event_id::BIGINT AS t, value AS v, (event_type = 'error')::INT AS label FROM events), n AS (SELECT count(*) AS n FROM s)
SELECT window_id, (t - window_id * 32)::INT AS pos, v, label FROM (SELECT unnest(range(0, (n - 64) // 32 + 1)) AS window_id FROM n) JOIN s ON t >= window_id * 32 AND t < window_id * 32 + 64""")
def signal_windows(spark, sf_dir):
    rows = fx.signal(spark, sf_dir)
    made = windows.signal_windows(rows, 64, 32, rows.count())
    return made.select("window_id", F.posexplode(F.arrays_zip("values", "labels")).alias("pos", "_s")).select("window_id", "pos", F.col("_s.values").alias("v"), F.col("_s.labels").alias("label"))


@query(f"""WITH {fx.sql_frames(Layout(20, 20, 0, 1))} SELECT s::BIGINT AS sample, lag::BIGINT AS lag, (s * 2 + lag)::BIGINT AS window_id
FROM (SELECT unnest(range(0, (nw - 3 + 1) // 2)) AS s FROM nw WHERE nw > 3), (SELECT unnest(range(0, 4)) AS lag)""")
def history_target_pairs(spark, sf_dir):
    p = fx.Prepared(spark, sf_dir)
    return windows.history_pairs(spark, Layout(20, 20).count(p.n), 3, 2)


_SAVED = Layout(20, 20, 0, 4)


@query(f"""WITH {fx.sql_frames(_SAVED)}, c AS (SELECT DISTINCT window_id, channel FROM asm), s AS (SELECT *, unnest(range(0, 8)) AS slot FROM c)
SELECT s.window_id, s.channel, s.slot::INT AS slot, round(coalesce(CASE WHEN s.slot % 2 = 0 THEN sum ELSE cnt END, 0)::DOUBLE, 6) AS value, '20' AS window_size, b.run AS first_run
FROM s LEFT JOIN asm a ON a.window_id = s.window_id AND a.channel = s.channel AND a.bin = s.slot // 2 JOIN idx b ON b.event_idx = s.window_id * 20""")
def saved_windows(spark, sf_dir):
    """Windows, their metadata and settings written and read back; bins flattened."""
    p, path = fx.Prepared(spark, sf_dir), scratch(spark, "saved")
    # a folder for each range of windows, so that a range reads its own files alone; a range is dealt whole, so that it has one file
    n = _SAVED.count(p.n)
    made = windows.ranged_bin_arrays(p.hits, _SAVED, p.n, ("sum", "cnt"), max(256, -(-n // 1024)))
    files.save_windows(made, windows.provenance(spark, p.events, _SAVED, p.n), {"window_size": _SAVED.size}, path, partition_by="window_range")
    rows, meta, settings = files.load_windows(spark, path)
    # windows meet their metadata before their bins become rows; some 16 bytes of each are broadcast, if they are few
    first = meta.select("window_id", "first_run")
    known = files.flatten_bins(rows).select("window_id", "channel", "bins").join(F.broadcast(first) if n <= 1_000_000 else first, "window_id")
    flat = known.select("window_id", "channel", F.posexplode("bins").alias("slot", "value"), "first_run", F.lit(settings["window_size"]).alias("window_size"))
    return rounded(flat, "value")


# --- graphs and forecasts ---------------------------------------------------------------------------------------


class Graph:
    """Assembled windows and active nodes with the standard layout."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        p = fx.Prepared(spark, sf_dir)
        self.n = LAYOUT.count(p.n)
        # nodes, scores and vectors all start from the frames, which cost most to make
        self.rows = graph.assemble(Stored(p.frames(LAYOUT), "frames").df, LAYOUT, self.n)
        self.prepared = p

    @cached_property
    def channels(self) -> int:
        return hits.channel_count(fx.hits(self.prepared.spark, self.prepared.sf_dir))

    @property
    def nodes(self) -> DataFrame:
        return graph.active_nodes(self.rows, LAYOUT, self.n)

    @property
    def cells(self) -> DataFrame:
        return graph.node_cells(self.rows, LAYOUT, self.n)


_GRAPH = fx.sql_frames(LAYOUT) + "," + fx.SQL_NODES.format(history=LAYOUT.history)
_SCORES = f"""{_GRAPH},
cells AS (SELECT window_id, channel, bin, {", ".join(f"sum(CASE w WHEN 4 THEN -{f} WHEN 3 THEN {f} ELSE 0 END) AS d_{f}" for f in windows.DEFAULT_FEATURES)} FROM asm JOIN nodes USING (window_id, channel) GROUP BY ALL),
mses AS (SELECT n.window_id, n.channel, coalesce(sum({" + ".join(f"d_{f} * d_{f}" for f in windows.DEFAULT_FEATURES)}), 0) / {CELLS} AS mse FROM nodes n LEFT JOIN cells c USING (window_id, channel) GROUP BY ALL)"""


@query(f"WITH {_GRAPH} SELECT window_id, channel, node_rank, round(node_rank / greatest(m - 1, 1), 9) AS rank_index FROM nodes")
def active_nodes(spark, sf_dir):
    return rounded(Graph(spark, sf_dir).nodes, "rank_index", digits=9)


@query(f"""WITH {_GRAPH}, c AS (SELECT window_id, channel, row_number() OVER (PARTITION BY window_id ORDER BY channel) - 1 AS node_rank FROM asm GROUP BY window_id, channel HAVING sum(abs(sum) + abs(min) + abs(max) + abs(stdev) + abs(cnt)) > 0)
SELECT window_id, channel, node_rank, round(channel / greatest(1, (SELECT max(channel) FROM hit)), 9) AS channel_index FROM c WHERE node_rank < 30""")
def collate_nodes(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return rounded(graph.collate_nodes(g.rows, g.channels, max_nodes=30), "channel_index", digits=9)


_SLOTS = ", ".join(f"{{'slot': 1 + (w * {LAYOUT.bins} + bin) * {len(windows.DEFAULT_FEATURES)} + {i}, 'value': {f}::DOUBLE}}" for i, f in enumerate(windows.DEFAULT_FEATURES))


@query(f"""WITH {_GRAPH}, x AS (SELECT window_id, channel, unnest([{_SLOTS}], recursive := true) FROM asm JOIN nodes USING (window_id, channel) WHERE w < {LAYOUT.history}),
s AS (SELECT window_id, channel, slot::BIGINT AS slot, value FROM x WHERE value <> 0 UNION ALL SELECT window_id, channel, 0, (node_rank / greatest(m - 1, 1))::DOUBLE FROM nodes)
SELECT window_id, channel, count(*) AS n_slots, string_agg(slot || ':' || floor(value * 1e6 + 0.50001)::BIGINT, ' ' ORDER BY slot) AS vector FROM s GROUP BY ALL""")
def node_vectors(spark, sf_dir):
    """A row a node: the slots of its vector that are not zero, in millionths."""
    p = fx.Prepared(spark, sf_dir)
    return window_pass.entry_texts(p.hits, LAYOUT, p.n)


@query(f"""WITH {_GRAPH}, t AS (SELECT window_id, channel, sum(sum) AS s, sum(cnt) AS c FROM asm WHERE w = 4 GROUP BY ALL), h AS (SELECT window_id, channel, sum(sum) AS s FROM asm WHERE w < 4 GROUP BY ALL)
SELECT n.window_id, n.channel, n.node_rank, 81 AS x_width, 20 AS y_width, coalesce(h.s, 0) AS x_sum, coalesce(t.s, 0) AS y_sum, coalesce(t.c, 0)::DOUBLE AS y_cnt FROM nodes n LEFT JOIN t USING (window_id, channel) LEFT JOIN h USING (window_id, channel)""")
def node_vector_sums(spark, sf_dir):
    p = fx.Prepared(spark, sf_dir)
    return window_pass.node_sums(p.hits, LAYOUT, p.n)


@query("WITH n AS (SELECT max(l_suppkey) + 1 AS n FROM lineitem), c AS (SELECT unnest(range(0, n)) AS src FROM n) SELECT src, dst::BIGINT AS dst FROM (SELECT src, unnest(range(src - 4, src + 5)) AS dst FROM c), n WHERE dst >= 0 AND dst < n")
def band_edges(spark, sf_dir):
    return graph.band_edges(spark, hits.channel_count(fx.hits(spark, sf_dir)), RADIUS)


_EDGES = f"{_GRAPH}, edges AS (SELECT a.window_id, a.node_rank AS src, b.node_rank AS dst, a.channel AS src_channel, b.channel AS dst_channel FROM (SELECT *, channel + unnest(range(-{RADIUS}, {RADIUS} + 1)) AS other FROM nodes) a JOIN nodes b ON a.window_id = b.window_id AND a.other = b.channel)"


@query(f"""WITH {_EDGES} SELECT window_id, src, src_channel, count(*) AS degree, string_agg(dst || ':' || dst_channel, ' ' ORDER BY dst) AS neighbours FROM edges GROUP BY ALL""")
def pruned_edges(spark, sf_dir):
    """A row a node: all edges from it."""
    edges = graph.pruned_edges(Graph(spark, sf_dir).nodes, RADIUS)
    ends = F.sort_array(F.collect_list(F.struct("dst", "dst_channel")))  # as many as the radius allows
    text = F.array_join(F.transform(ends, lambda e: F.concat_ws(":", e["dst"], e["dst_channel"])), " ")
    return edges.groupBy("window_id", "src", "src_channel").agg(F.count("*").alias("degree"), text.alias("neighbours"))


_VALUES = "vals AS (SELECT window_id, channel, sum(sum) AS value FROM asm WHERE w = 3 GROUP BY ALL)"


def _last_sums(g: Graph) -> DataFrame:
    return g.rows.filter(F.col("w") == LAYOUT.history - 1).groupBy("window_id", "channel").agg(F.sum("sum").alias("value"))


@query(f"WITH {_EDGES}, {_VALUES} SELECT e.window_id, e.dst_channel AS channel, sum(v.value) AS value FROM edges e JOIN vals v ON v.window_id = e.window_id AND v.channel = e.src_channel GROUP BY ALL")
def neighbour_sum(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return graph.neighbour_sum(g.nodes, _last_sums(g), RADIUS)


@query(f"""WITH {_EDGES}, {_VALUES}, deg AS (SELECT window_id, src_channel AS channel, count(*) AS d FROM edges GROUP BY ALL)
SELECT e.window_id, e.dst_channel AS channel, round(sum(v.value / sqrt(a.d)) / sqrt(any_value(b.d)), 6) AS value FROM edges e JOIN vals v ON v.window_id = e.window_id AND v.channel = e.src_channel
JOIN deg a ON a.window_id = e.window_id AND a.channel = e.src_channel JOIN deg b ON b.window_id = e.window_id AND b.channel = e.dst_channel GROUP BY ALL""")
def neighbour_norm(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return rounded(graph.neighbour_norm(g.nodes, _last_sums(g), RADIUS), "value")


_LAYER = """SELECT e.window_id, e.dst_channel AS channel, v.w, {sums} FROM edges e JOIN {values} v ON v.window_id = e.window_id AND v.channel = e.src_channel
JOIN deg a ON a.window_id = e.window_id AND a.channel = e.src_channel JOIN deg b ON b.window_id = e.window_id AND b.channel = e.dst_channel GROUP BY ALL"""


def _layer(values: str) -> str:
    """SQL of one step of degree-normalised propagation."""
    return _LAYER.format(values=values, sums=", ".join(f"sum(v.{f} / sqrt(a.d)) / sqrt(any_value(b.d)) AS {f}" for f in windows.DEFAULT_FEATURES))


@query(f"""WITH {_EDGES}, deg AS MATERIALIZED (SELECT window_id, src_channel AS channel, count(*) AS d FROM edges GROUP BY ALL),
zero AS (SELECT window_id, channel, unnest(range(0, {LAYOUT.history})) AS w FROM nodes),
v0 AS MATERIALIZED (SELECT z.window_id, z.channel, z.w, {", ".join(f"coalesce(sum(a.{f}), 0)::DOUBLE AS {f}" for f in windows.DEFAULT_FEATURES)} FROM zero z LEFT JOIN asm a ON a.window_id = z.window_id AND a.channel = z.channel AND a.w = z.w GROUP BY ALL),
v1 AS MATERIALIZED ({_layer("v0")}), v2 AS ({_layer("v1")})
SELECT window_id, channel, w::BIGINT AS w, {", ".join(f"round({f} + {NUDGE}, 6) AS {f}" for f in windows.DEFAULT_FEATURES)} FROM v2""")
def stacked_propagation(spark, sf_dir):
    """Two layers of propagation over all features of every past frame; bins are added up, as the steps are linear."""
    p = fx.Prepared(spark, sf_dir)
    summed = window_pass.propagated_sums(p.hits, LAYOUT, p.n, layers=2, radius=RADIUS)
    for f in windows.DEFAULT_FEATURES:
        summed = nudged(summed, f)
    return summed


@query(f"WITH {_SCORES} SELECT window_id, channel, round(mse, 9) AS mse FROM mses")
def forecast_node_scores(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return rounded(score.forecast_node_scores(g.rows, LAYOUT, g.n), "mse", digits=9)


@query(f"""WITH {_GRAPH}, c AS (SELECT window_id, channel, bin, {", ".join(f"sum(CASE w WHEN 4 THEN -{f} ELSE {f} / 4.0 END) AS d_{f}" for f in windows.DEFAULT_FEATURES)} FROM asm JOIN nodes USING (window_id, channel) GROUP BY ALL)
SELECT n.window_id, n.channel, round(coalesce(sum({" + ".join(f"d_{f} * d_{f}" for f in windows.DEFAULT_FEATURES)}), 0) / {CELLS} + {NUDGE}, 6) AS mse FROM nodes n LEFT JOIN c USING (window_id, channel) GROUP BY ALL""")
def history_mean_scores(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return nudged(score.forecast_node_scores(g.rows, LAYOUT, g.n, forecast="history_mean"), "mse")


_FEATS = windows.DEFAULT_FEATURES


@query(f"""WITH {_EDGES}, deg AS (SELECT window_id, dst_channel AS channel, count(*) AS d FROM edges GROUP BY ALL),
told AS (SELECT e.window_id, e.dst_channel AS channel, a.bin, {", ".join(f"sum(a.{f}) / any_value(g.d) AS {f}" for f in _FEATS)} FROM edges e JOIN asm a ON a.window_id = e.window_id AND a.channel = e.src_channel AND a.w = 3 JOIN deg g ON g.window_id = e.window_id AND g.channel = e.dst_channel GROUP BY ALL),
both_ AS (SELECT * FROM told UNION ALL SELECT window_id, channel, bin, {", ".join(f"-{f}" for f in _FEATS)} FROM asm JOIN nodes USING (window_id, channel) WHERE w = 4),
c AS (SELECT window_id, channel, bin, {", ".join(f"sum({f}) AS d_{f}" for f in _FEATS)} FROM both_ GROUP BY ALL)
SELECT n.window_id, n.channel, round(coalesce(sum({" + ".join(f"d_{f} * d_{f}" for f in _FEATS)}), 0) / {CELLS} + {NUDGE}, 6) AS mse FROM nodes n LEFT JOIN c USING (window_id, channel) GROUP BY ALL""")
def neighbour_forecast_scores(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return nudged(window_pass.neighbour_forecast(g.rows, LAYOUT, g.n), "mse")


_WINDOWS = f"{_SCORES}, ws AS (SELECT window_id, avg(mse) AS score_mean, max(mse) AS score_max, count(*) AS n_nodes FROM mses GROUP BY window_id)"


def _window_scores(spark, sf_dir) -> DataFrame:
    g = Graph(spark, sf_dir)
    return score.window_scores(score.forecast_node_scores(g.rows, LAYOUT, g.n))


@query(f"WITH {_WINDOWS} SELECT window_id, round(score_mean, 9) AS score_mean, round(score_max, 9) AS score_max, n_nodes, score_max > 2000.25 AS is_anomaly FROM ws")
def forecast_window_scores(spark, sf_dir):
    scores = _window_scores(spark, sf_dir)
    return rounded(scores.withColumn("is_anomaly", score.flag(score.score_column("max"), 2000.25)), "score_mean", "score_max", digits=9)


@query(f"WITH {_WINDOWS} SELECT window_id, round(score_mean, 9) AS score_mean, round(score_max, 9) AS score_max, n_nodes, score_max > 2000.25 OR score_mean > 1000.125 AS alert FROM ws")
def dual_rule_alerts(spark, sf_dir):
    return rounded(score.dual_rule(_window_scores(spark, sf_dir), 2000.25), "score_mean", "score_max", digits=9)


@query(f"WITH {_WINDOWS} SELECT window_id, round(score_max, 9) AS score_max FROM ws ORDER BY ws.score_max DESC, window_id LIMIT 10")
def top_windows(spark, sf_dir):
    return rounded(score.top_windows(_window_scores(spark, sf_dir), 10).select("window_id", "score_max"), "score_max", digits=9)


@query(f"WITH {_WINDOWS} SELECT window_id, round(score_mean, 9) AS score_mean, round(score_max, 9) AS score_max FROM ws ORDER BY window_id")
def score_series(spark, sf_dir):
    return rounded(_window_scores(spark, sf_dir).select("window_id", "score_mean", "score_max"), "score_mean", "score_max", digits=9).orderBy("window_id")


@query(f"WITH {_SCORES}, n AS (SELECT max(channel) + 1 AS n FROM hit), c AS (SELECT unnest(range(0, n)) AS channel FROM n) SELECT c.channel, round(avg(mse), 9) AS mse FROM c LEFT JOIN mses USING (channel) GROUP BY c.channel")
def channel_mse(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return rounded(score.channel_mse(score.forecast_node_scores(g.rows, LAYOUT, g.n), g.channels), "mse", digits=9)


@query(f"WITH {_SCORES}, n AS (SELECT max(channel) + 1 AS n FROM hit), c AS (SELECT window_id, unnest(range(0, n)) AS channel FROM wins, n) SELECT window_id, channel, round(mse, 9) AS mse FROM c LEFT JOIN mses USING (window_id, channel)")
def node_score_grid(spark, sf_dir):
    p = fx.Prepared(spark, sf_dir)
    runs = window_pass.score_runs(p.hits, LAYOUT, p.n, hits.channel_count(fx.hits(spark, sf_dir)))
    return score.score_grid(rounded(runs, "mse", digits=9))


def _half_and_quarter(x: np.ndarray, edges: np.ndarray, graph: np.ndarray) -> np.ndarray:
    """A linear model for the predictor plug-in: half the last frame, a quarter of the one before, an eighth of the number of neighbours."""
    return 0.5 * x[:, -CELLS:] + 0.25 * x[:, -2 * CELLS : -CELLS] + 0.125 * np.bincount(edges[1], minlength=len(x))[:, None]


_MODEL = f"""{_EDGES}, deg AS (SELECT window_id, dst_channel AS channel, count(*) AS d FROM edges GROUP BY ALL),
grid AS (SELECT n.window_id, n.channel, d, unnest(range(0, {LAYOUT.bins})) AS bin FROM nodes n JOIN deg USING (window_id, channel)),
told AS (SELECT g.window_id, g.channel, g.bin, any_value(d) AS d, {", ".join(f"coalesce(sum(CASE w WHEN 3 THEN 0.5 WHEN 2 THEN 0.25 WHEN 4 THEN -1 ELSE 0 END * a.{f}), 0) + 0.125 * any_value(d) AS d_{f}" for f in _FEATS)} FROM grid g LEFT JOIN asm a ON a.window_id = g.window_id AND a.channel = g.channel AND a.bin = g.bin GROUP BY ALL),
mses AS (SELECT window_id, channel, sum({" + ".join(f"d_{f} * d_{f}" for f in _FEATS)}) / {CELLS} AS mse FROM told GROUP BY ALL),
ws AS (SELECT window_id, avg(mse) AS score_mean, max(mse) AS score_max FROM mses GROUP BY window_id)"""


@query(f"""WITH {_MODEL} SELECT m.window_id, m.channel, round(mse + {NUDGE}, 6) AS mse, round(score_mean + {NUDGE}, 6) AS score_mean, round(score_max + {NUDGE}, 6) AS score_max, score_max > 2000.25 AS is_anomaly, a.run AS first_run, a.evt AS first_evt, b.evt AS last_evt, 'source-' || a.file_idx || '.root' AS first_file, 2000.25::DOUBLE AS threshold
FROM mses m JOIN ws USING (window_id) JOIN idx a ON a.event_idx = m.window_id * 20 JOIN idx b ON b.event_idx = m.window_id * 20 + 99""")
def model_scores(spark, sf_dir):
    """Inference from end to end: window graphs, a model's forecasts, node and window scores, flags and provenance, saved and read back."""
    g, path = Graph(spark, sf_dir), scratch(spark, "scores")
    model = predict.Model("gnn", _half_and_quarter, threshold=2000.25)
    node_scores = Stored(model.node_scores(g.rows, LAYOUT, g.n, radius=RADIUS).select("window_id", "channel", "mse"), "node_scores").df
    flagged = score.window_scores(node_scores).withColumn("is_anomaly", model.flag(score.score_column("max")))
    names = windows.files_first_seen(g.prepared.events).select("file_idx", F.format_string("source-%d.root", "file_idx").alias("path"))
    settings = {"threshold": model.threshold, "n_channels": g.channels, "features": ",".join(windows.DEFAULT_FEATURES)}
    files.save_scores(flagged.join(windows.provenance(spark, g.prepared.events, LAYOUT, g.prepared.n), "window_id"), node_scores, path, settings, names)
    (by_window, by_node), (made_with, sources) = files.load_scores(spark, path), files.load_score_record(spark, path)
    first = by_window.join(sources.select(F.col("file_idx").alias("first_file"), "path"), "first_file", "left").drop("first_file").withColumnRenamed("path", "first_file")
    kept = by_node.join(first.select("window_id", "score_mean", "score_max", "is_anomaly", "first_run", "first_evt", "last_evt", "first_file"), "window_id").withColumn("threshold", F.lit(float(made_with["threshold"])))
    for name in ("mse", "score_mean", "score_max"):
        kept = nudged(kept, name)
    return kept


_OVER = Layout(20, 20, 0, 1)


@query(f"""WITH {fx.sql_frames(_OVER)}, k AS (SELECT unnest(range(0, CASE WHEN nw > 3 THEN (nw - 3 + 1) // 2 ELSE 0 END)) AS sample FROM nw), part AS (SELECT sample, window_id - 2 * sample AS lag, channel, sum, cnt FROM k JOIN asm ON window_id >= 2 * sample AND window_id <= 2 * sample + 3),
act AS (SELECT sample, channel FROM part WHERE lag < 3 GROUP BY ALL HAVING sum(abs(sum) + cnt) > 1e-6), kept AS (SELECT * FROM act UNION ALL SELECT sample, 0 FROM k WHERE sample NOT IN (SELECT sample FROM act)),
n AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY channel) - 1 AS node_rank, count(*) OVER (PARTITION BY sample) AS m FROM kept), s AS (SELECT *, unnest(range(0, 9)) AS slot FROM n)
SELECT s.sample, s.channel, s.node_rank, s.slot::INT AS slot, round(CASE WHEN s.slot = 0 THEN s.node_rank / greatest(m - 1, 1) ELSE coalesce(CASE WHEN (s.slot - 1) % 2 = 0 THEN sum ELSE cnt END, 0) END::DOUBLE, 6) AS value
FROM s LEFT JOIN part p ON p.sample = s.sample AND p.channel = s.channel AND p.lag = (s.slot - 1) // 2 AND s.slot > 0""")
def history_graphs(spark, sf_dir):
    """Graph samples over materialised windows: node vectors of three past windows (slots 0 to 6) and of the target (7 and 8), every second window on."""
    p, over, names = fx.Prepared(spark, sf_dir), windows.over_windows(3, 2), ("sum", "cnt")
    made = windows.dense_window_features(p.hits, _OVER, p.n).withColumnRenamed("window_id", "frame_start")
    n = over.count(_OVER.count(p.n))
    cells = graph.node_cells(graph.assemble(made, over, n), over, n, names)
    full = graph.node_vectors(cells, over, len(names)).select(F.col("window_id").alias("sample"), "channel", "node_rank", F.posexplode(F.concat("x", "y")).alias("slot", "value"))
    return rounded(full, "value")


# --- joins and vectors ------------------------------------------------------------------------------------------


@query(f"WITH {fx.SQL_HITS} SELECT e.run, e.subrun, e.evt, round(l_extendedprice, 2) AS light FROM ev e JOIN lineitem l ON l.l_orderkey = e.evt")
def event_join(spark, sf_dir):
    """Events with every light signal of theirs; events without any have no row."""
    light = fx.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("long").alias("e"), F.round("l_extendedprice", 2).alias("light"))
    return score.join_events(fx.events(spark, sf_dir), light, {"evt": "e"}).select("run", "subrun", "evt", "light")


@query("""WITH v AS (SELECT vec_id, label = 0 AS label, embedding::DOUBLE[] AS x FROM embeddings) SELECT vec_id, label::INT AS label, unnest(range(0, 128))::INT AS slot, round(unnest(list_concat(x, x)), 6) AS value FROM v""")
def paired_vectors(spark, sf_dir):
    v = fx.vectors(spark, sf_dir)
    pair = v.select("vec_id", "x").join(v.select("vec_id", F.col("x").alias("y"), "label"), "vec_id")
    return pair.select("vec_id", "label", F.posexplode(F.concat("x", "y")).alias("slot", "value")).select("vec_id", "label", "slot", F.round("value", 6).alias("value"))


def _padded_sql(value: str, width: int, keep: str, k: int = 1) -> str:
    return f"""WITH {fx.SQL_LINES}, v AS (SELECT evt, {value} FROM lines WHERE {keep}), s AS (SELECT evt, unnest(range(0, {width})) AS slot FROM (SELECT DISTINCT evt FROM lines))
SELECT s.evt, s.slot::INT AS slot, round(coalesce(v.value, 0), 6) AS value FROM s LEFT JOIN v ON v.evt = s.evt AND v.slot = s.slot"""


@query(_padded_sql("i AS slot, l_quantity AS value", 6, "true"))
def waveform_vectors(spark, sf_dir):
    rows = fx.ragged(spark, sf_dir).select("evt", vec.pad(vec.flatten_waveform(F.array("quantity")), 6).alias("x"))
    return slots(rows, "evt", "x")


_INTER = "unnest([{'slot': i * 2, 'value': l_quantity}, {'slot': i * 2 + 1, 'value': l_discount}], recursive := true)"


@query(_padded_sql(_INTER, 10, "true"))
def interleaved_vectors(spark, sf_dir):
    rows = fx.ragged(spark, sf_dir).select("evt", vec.pad(vec.interleave([F.col("quantity"), F.lit(None).cast("array<double>"), F.col("discount")]), 10).alias("x"))
    return slots(rows, "evt", "x")


@query(_padded_sql(_INTER, 6, "i < 3"))
def max_hits_vectors(spark, sf_dir):
    rows = fx.ragged(spark, sf_dir).select("evt", vec.interleave([F.col("quantity"), F.col("discount")], hits=3).alias("x"))
    return slots(rows, "evt", "x")


@query(f"""WITH {fx.SQL_LINES}, m AS (SELECT max(n) AS m FROM lines), s AS (SELECT evt, unnest(range(0, m)) AS slot FROM (SELECT DISTINCT evt FROM lines), m)
SELECT s.evt, s.slot::INT AS slot, round(coalesce(l_quantity, 0), 6) AS value FROM s LEFT JOIN lines l ON l.evt = s.evt AND l.i = s.slot""")
def padded_to_max(spark, sf_dir):
    return slots(vec.pad_to_longest(fx.ragged(spark, sf_dir).select("evt", F.col("quantity").alias("x")), "x"), "evt", "x")


_LONG = "v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), l AS (SELECT vec_id, unnest(range(0, len(x)))::INT AS slot, unnest(x) AS e FROM v)"


@query(f"WITH {_LONG}, k AS (SELECT vec_id, slot, CASE WHEN vec_id % 10 = 0 THEN 2.0 ELSE e END AS e FROM l), m AS (SELECT vec_id, avg(e) AS m, stddev_pop(e) AS s FROM k GROUP BY vec_id) SELECT vec_id, slot, round(CASE WHEN s > 1e-12 THEN (e - m) / s ELSE e END, 6) AS value FROM k JOIN m USING (vec_id)")
def zscore_keep(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).withColumn("x", F.when(F.col("vec_id") % 10 == 0, F.transform("x", lambda e: F.lit(2.0))).otherwise(F.col("x")))
    return slots(v.select("vec_id", vec.zscore_keep(F.col("x")).alias("x")), "vec_id", "x")


@query(f"WITH {_LONG}, k AS (SELECT vec_id, slot, CASE WHEN vec_id % 10 = 0 THEN 2.0 ELSE e END AS e FROM l), m AS (SELECT vec_id, avg(e) AS m, stddev_pop(e) AS s FROM k GROUP BY vec_id) SELECT vec_id, slot, round(CASE WHEN s > 1e-12 THEN (e - m) / s ELSE e - m END, 6) AS value FROM k JOIN m USING (vec_id)")
def zscore_unit(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).withColumn("x", F.when(F.col("vec_id") % 10 == 0, F.transform("x", lambda e: F.lit(2.0))).otherwise(F.col("x")))
    return slots(v.select("vec_id", vec.zscore_unit(F.col("x")).alias("x")), "vec_id", "x")


@query(f"WITH {_LONG}, m AS (SELECT slot, avg(e) AS m, stddev_pop(e) AS s FROM l GROUP BY slot) SELECT vec_id, slot, round((e - m) / (s + 1e-6), 6) AS value FROM l JOIN m USING (slot)")
def zscore_columns(spark, sf_dir):
    return slots(vec.zscore_columns(fx.vectors(spark, sf_dir), "x"), "vec_id", "x")


@query(f"WITH {_LONG}, m AS (SELECT avg(e) AS m, stddev_pop(e) AS s FROM l) SELECT vec_id, slot, round((e - m) / (s + 1e-6), 6) AS value FROM l, m")
def zscore_global(spark, sf_dir):
    return slots(vec.zscore_all(fx.vectors(spark, sf_dir), "x"), "vec_id", "x")


@query(f"WITH {_LONG}, k AS (SELECT vec_id, slot, CASE WHEN (vec_id + slot) % 7 = 0 THEN 0 ELSE e END AS e FROM l) SELECT vec_id, slot, round(e, 6) AS value, true AS repaired FROM k")
def repair_non_finite(spark, sf_dir):
    bad = F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf")))
    v = fx.vectors(spark, sf_dir).withColumn("x", F.transform("x", lambda e, i: F.when((F.col("vec_id") + i) % 7 == 0, F.get(bad, i % 3)).otherwise(e)))
    made = v.select("vec_id", vec.repair(F.col("x")).alias("x"), vec.has_non_finite(F.col("x")).alias("repaired"))
    return made.select("vec_id", F.posexplode("x").alias("slot", "value"), "repaired").select("vec_id", "slot", F.round("value", 6).alias("value"), "repaired")


@query(f"WITH {_LONG} SELECT vec_id, slot - 8 AS slot, round(e, 6) AS value FROM l WHERE slot >= 8 UNION ALL SELECT vec_id, unnest(range(56, 70))::INT, 0 FROM v")
def sliced_vectors(spark, sf_dir):
    return slots(fx.vectors(spark, sf_dir).select("vec_id", vec.window(F.col("x"), 8, 70).alias("x")), "vec_id", "x")


@query("""SELECT slot, 'v' || (slot % 5) AS variable, (slot // 5)::BIGINT AS hit, count(*) AS n FROM (SELECT unnest(range(0, len(embedding)))::INT AS slot FROM embeddings) GROUP BY ALL""")
def feature_labels(spark, sf_dir):
    rows = fx.vectors(spark, sf_dir).select(F.posexplode("x").alias("slot", "value")).groupBy("slot").agg(F.count("*").alias("n"))
    return rows.select("slot", vec.feature_label(F.col("slot"), [f"v{i}" for i in range(5)]).alias("l"), "n").select("slot", "l.variable", "l.hit", "n")


# --- scores and evaluation --------------------------------------------------------------------------------------

_RECON = "rec AS (SELECT vec_id, (label = 0)::INT AS label, list_sum(list_transform(embedding::DOUBLE[], lambda e: (e - floor(e * 10 + 0.5) / 10) * (e - floor(e * 10 + 0.5) / 10))) / len(embedding) AS score FROM embeddings)"


def _reconstructed(spark, sf_dir) -> DataFrame:
    v = fx.vectors(spark, sf_dir).withColumn("x_hat", F.transform("x", lambda e: F.floor(e * 10 + F.lit(0.5)) / 10))
    return score.reconstruction_scores(v, "x", "x_hat")


@query(f"WITH {_RECON} SELECT vec_id, label, round(score, 9) AS score FROM rec")
def reconstruction_scores(spark, sf_dir):
    return rounded(_reconstructed(spark, sf_dir).select("vec_id", "label", "score"), "score", digits=9)


_NETWORK = predict.DenseReLU.seeded([64, 8, 64])


def _network_sql() -> str:
    """The network's layers written out: a weighted sum for each output."""
    (w1, _), (w2, _) = _NETWORK.layers
    sums = lambda w, x: ", ".join(f"list_inner_product({[float(c) for c in row]}, {x})" for row in w)
    hidden = f"list_transform([{sums(w1, 'x')}], lambda h: greatest(h, 0))"
    return f"""WITH v AS (SELECT vec_id, (label = 0)::INT AS label, embedding::DOUBLE[] AS x FROM embeddings), h AS (SELECT *, {hidden} AS h FROM v), y AS (SELECT *, [{sums(w2, 'h')}] AS y FROM h)
SELECT vec_id, label, round(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(x), 6) AS score FROM y"""


@query(_network_sql())
def network_scores(spark, sf_dir):
    """A dense network's reconstruction errors."""
    return rounded(predict.score_vectors(fx.vectors(spark, sf_dir), "x", _NETWORK).select("vec_id", "label", "score"), "score")


def _fused(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A joint model of two vectors: half of each value, and a quarter of the other detector's first one."""
    return np.concatenate([0.5 * a + 0.25 * b[:, :1], 0.5 * b + 0.25 * a[:, :1]], axis=1)


@query(f"""WITH {fx.SQL_LINES}, k AS (SELECT o_orderkey::BIGINT AS evt FROM orders), s AS (SELECT evt, unnest(range(0, 6)) AS slot FROM k),
a AS (SELECT s.evt, s.slot, coalesce(l_quantity, 0)::DOUBLE AS v FROM s LEFT JOIN lines l ON l.evt = s.evt AND l.i = s.slot), b AS (SELECT s.evt, s.slot, coalesce(10 * l_tax, 0)::DOUBLE AS v FROM s LEFT JOIN lines l ON l.evt = s.evt AND l.i = s.slot WHERE s.slot < 4),
c AS (SELECT x.evt, x.v - (0.5 * x.v + 0.25 * y.v) AS d FROM a x JOIN b y ON x.evt = y.evt AND y.slot = 0 UNION ALL SELECT x.evt, x.v - (0.5 * x.v + 0.25 * y.v) FROM b x JOIN a y ON x.evt = y.evt AND y.slot = 0)
SELECT evt, round(sum(d * d) / 10 + {NUDGE}, 6) AS score, sum(d * d) / 10 + {NUDGE} > 90.000005 AS is_anomaly FROM c WHERE evt IN (SELECT evt FROM lines) GROUP BY evt""")
def fusion_scores(spark, sf_dir):
    """Vectors of two sub-detectors, joined by event, under a joint model."""
    rows = fx.ragged(spark, sf_dir)
    tpc, pmt = rows.select("evt", vec.pad(F.col("quantity"), 6).alias("tpc")), rows.select("evt", vec.pad(F.transform("tax", lambda t: t * 10), 4).alias("pmt"))
    model = predict.Model("fusion", _fused, threshold=90.000005)
    scored = nudged(model.scores(score.join_events(tpc, pmt, ["evt"]), "tpc", "pmt").withColumn("is_anomaly", model.flag(F.col("score") + NUDGE)), "score")
    return scored.select("evt", "score", "is_anomaly")


def _one_before(x: np.ndarray) -> np.ndarray:
    """A model of windows (rows x channels x time): each value is told to be the one before it."""
    return np.concatenate([np.zeros_like(x[..., :1]), x[..., :-1]], axis=-1)


@query(f"""WITH s AS (SELECT event_id::BIGINT AS t, value::DOUBLE AS v, (event_type = 'error')::INT::DOUBLE AS e FROM events), n AS (SELECT count(*) AS n FROM s),
w AS (SELECT window_id, t, c, CASE c WHEN 0 THEN v ELSE e END AS x FROM (SELECT unnest(range(0, (n - 64) // 32 + 1)) AS window_id FROM n) JOIN s ON t >= window_id * 32 AND t < window_id * 32 + 64, (VALUES (0), (1)) k(c)),
m AS (SELECT window_id, c, avg(x) AS m, stddev_pop(x) AS s FROM w GROUP BY ALL), z AS (SELECT w.window_id, w.c, t, (x - m) / CASE WHEN s > 1e-12 THEN s ELSE 1 END AS z FROM w JOIN m ON m.window_id = w.window_id AND m.c = w.c)
SELECT window_id, round(avg(d * d) + {NUDGE}, 6) AS score FROM (SELECT window_id, z - coalesce(lag(z) OVER (PARTITION BY window_id, c ORDER BY t), 0) AS d FROM z) GROUP BY window_id""")
def window_model_scores(spark, sf_dir):
    """Windows of two channels over time under a model of windows, each channel z-scored."""
    rows = fx.signal(spark, sf_dir)
    made = windows.signal_windows(rows, 64, 32, rows.count())
    grids = made.select("window_id", F.array("values", F.transform("labels", lambda e: e.cast("double"))).alias("x"))
    return nudged(predict.Model("window", _one_before, normalise=True).scores(grids, "x").select("window_id", "score"), "score")


@query("""WITH p AS (SELECT l_orderkey, count(*) / 7.0 AS b, max(l_discount) AS c FROM lineitem GROUP BY l_orderkey),
t AS (SELECT year(o_orderdate)::BIGINT AS run, month(o_orderdate)::BIGINT AS subrun, o_orderkey::BIGINT AS evt, round(o_totalprice / 1e6, 6) AS a, round(coalesce(b, 0), 6)::DOUBLE AS b, round(coalesce(c, 0), 6)::DOUBLE AS c FROM orders LEFT JOIN p ON p.l_orderkey = o_orderkey)
SELECT run, subrun, evt, a AS tpc_score, b AS pmt_score, c AS window_score, greatest(a, b, c) AS max_score, a > 0.45 OR b > 0.5 AS alert FROM t""")
def multi_branch_alerts(spark, sf_dir):
    """Three branches of scores; events without lines have one in the first alone."""
    o, lines = fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "lineitem")
    key = [F.year("o_orderdate").cast("long").alias("run"), F.month("o_orderdate").cast("long").alias("subrun"), F.col("o_orderkey").cast("long").alias("evt")]
    scored = lambda value: o.join(lines.groupBy("l_orderkey").agg(F.round(value, 6).alias("score")), F.col("o_orderkey") == F.col("l_orderkey")).select(*key, "score")
    branches = {
        "tpc": o.select(*key, F.round(F.col("o_totalprice") / 1e6, 6).alias("score")),
        "pmt": scored(F.count("*") / 7.0),
        "window": scored(F.max("l_discount").cast("double")),
    }
    return score.multi_branch(branches, {"tpc": 0.45, "pmt": 0.5, "window": None})


_LABELLED = "s AS (SELECT n_chars::DOUBLE AS score, toxic AS label FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {_LABELLED} SELECT round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std, min(score) AS min, max(score) AS max, round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.95), 4) AS p95, round(quantile_cont(score, 0.99), 4) AS p99 FROM s")
def score_stats(spark, sf_dir):
    return rounded(metrics.score_stats(fx.labelled_scores(spark, sf_dir)), "mean", "std", "p50", "p95", "p99", digits=4)


@query(f"WITH {_LABELLED} SELECT round(avg((score >= 1000)::INT), 9) AS fraction FROM s")
def anomaly_fraction(spark, sf_dir):
    return rounded(score.anomaly_fraction(fx.labelled_scores(spark, sf_dir), 1000), "fraction", digits=9)


@query(f"WITH {_LABELLED}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM s) SELECT least(floor((score - lo) / (hi - lo) * 100), 99)::BIGINT AS bin, lo, hi, count(*) AS n, (SELECT round(quantile_cont(score, 0.95), 4) FROM s) AS p95, (SELECT round(quantile_cont(score, 0.99), 4) FROM s) AS p99, 1000::DOUBLE AS threshold FROM s, e GROUP BY ALL")
def score_histogram(spark, sf_dir):
    return rounded(metrics.score_histogram(fx.labelled_scores(spark, sf_dir), threshold=1000), "p95", "p99", digits=4)


_SKETCH = 1024


@query("SELECT count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value)::DOUBLE AS min, max(value)::DOUBLE AS max, true AS p50_within, true AS p95_within, true AS p99_within FROM events")
def running_score_stats(spark, sf_dir):
    """Statistics of a stream, merged from those of its micro-batches; the sketch's percentiles must lie within its stated error in rank."""
    folder = scratch(spark, "running")

    def keep(batch: DataFrame, number: int) -> None:
        metrics.sketch_stats(batch, "value", k=_SKETCH).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")

    jobs.run_batches(_event_stream(spark, sf_dir).select(F.col("value").cast("double").alias("value")), keep, f"{folder}/checkpoint")
    told = Stored(metrics.read_stats(metrics.merge_stats(spark.read.parquet(f"{folder}/parts").drop("batch"))), "running").df
    x, names = F.col("value").cast("double"), [f"p{round(100 * p)}" for p in metrics.PERCENTILES]
    # the ranks that a value holds: from the share of values below it to the share of those not above
    ranks = fx.table(spark, sf_dir, "events").crossJoin(F.broadcast(told.select(*names))).agg(*[F.avg((x < F.col(p)).cast("double")).alias(f"{p}_lo") for p in names], *[F.avg((x <= F.col(p)).cast("double")).alias(f"{p}_hi") for p in names])
    error = metrics.rank_error(_SKETCH)
    within = [((F.col(f"{n}_lo") <= p + error) & (F.col(f"{n}_hi") >= p - error)).alias(f"{n}_within") for n, p in zip(names, metrics.PERCENTILES, strict=True)]
    return rounded(told.crossJoin(F.broadcast(ranks)).select("n", "mean", "std", "min", "max", *within), "mean", "std")


@query(f"""WITH {_LONG}, p AS (SELECT slot::BIGINT AS feature, e AS x, floor(e * 10 + 0.5) / 10 AS y FROM l), b AS (SELECT feature, min(least(x, y)) AS lo, max(greatest(x, y)) AS hi FROM p GROUP BY feature),
c AS (SELECT feature, CASE WHEN feature % 4 = 1 THEN -0.2 WHEN feature % 4 = 2 THEN -0.1 ELSE lo END AS lo, CASE WHEN feature % 4 = 1 THEN 0.2 WHEN feature % 4 = 2 THEN 0.1 ELSE hi END AS hi, CASE WHEN feature % 4 = 1 THEN 5 WHEN feature % 4 = 2 THEN 8 ELSE 10 END AS bins FROM b),
d AS (SELECT feature, lo, hi, bins, CASE WHEN feature % 4 = 2 THEN least(greatest(x, lo), hi) ELSE x END AS x, CASE WHEN feature % 4 = 2 THEN least(greatest(y, lo), hi) ELSE y END AS y FROM p JOIN c USING (feature))
SELECT feature, least(floor((x - lo) / (hi - lo) * bins), bins - 1)::BIGINT AS xb, least(floor((y - lo) / (hi - lo) * bins), bins - 1)::BIGINT AS yb, count(*) AS n FROM d WHERE x BETWEEN lo AND hi AND y BETWEEN lo AND hi GROUP BY ALL""")
def reconstruction_hist2d(spark, sf_dir):
    v = fx.vectors(spark, sf_dir).withColumn("y", F.transform("x", lambda e: F.floor(e * 10 + F.lit(0.5)) / 10))
    spec = {"b": {"bins": 5, "range": [-0.2, 0.2]}, "c": {"bins": 8, "underflow": -0.1, "overflow": 0.1}}
    return metrics.hist2d(v, "x", "y", spec, ["a", "b", "c", "d"])


_ROC = f"""{_LABELLED}, g AS (SELECT score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM s GROUP BY score),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER w AS idx, lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM g WINDOW w AS (ORDER BY score DESC)),
tot AS (SELECT sum(pos) AS p, sum(neg) AS n, count(*) AS last FROM g),
roc AS (SELECT 0 AS idx, 'inf'::DOUBLE AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr UNION ALL SELECT idx, score, fp / n, tp / p FROM cum, tot WHERE idx = 1 OR idx = last OR pos <> np OR neg <> nn)"""


@query(f"WITH {_ROC} SELECT idx::BIGINT AS idx, threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM roc")
def roc_curve(spark, sf_dir):
    return rounded(metrics.roc_curve(fx.labelled_scores(spark, sf_dir)), "fpr", "tpr", digits=9)


@query(f"WITH {_LABELLED} SELECT round(sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 9)::DOUBLE AS auc FROM s a JOIN s b ON a.label = 1 AND b.label = 0")
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(fx.labelled_scores(spark, sf_dir)), "auc", digits=9)


@query(f"WITH {_ROC} SELECT threshold FROM roc ORDER BY abs(fpr - 0.05), idx LIMIT 1")
def threshold_at_fpr(spark, sf_dir):
    return metrics.threshold_at_fpr(fx.labelled_scores(spark, sf_dir), 0.05)


@query(f"""WITH {_ROC}, f AS (SELECT score, tp / (tp + fp) AS pr, tp / p AS rc FROM cum, tot), h AS (SELECT *, 2 * pr * rc / (pr + rc + 1e-12) AS f1 FROM f ORDER BY f1 DESC, score LIMIT 1)
SELECT round(pr, 9) AS "precision", round(rc, 9) AS recall, round(2 * pr * rc / (pr + rc), 9) AS f1, score AS threshold FROM h""")
def best_f1(spark, sf_dir):
    return rounded(metrics.best_f1(fx.labelled_scores(spark, sf_dir)), "precision", "recall", "f1", digits=9)


# --- ablation and splits ----------------------------------------------------------------------------------------

_BRANCHES = ["quantity", "discount", "tax"]


def _variants_sql() -> str:
    each = [f"SELECT '{name}' AS variant, '{','.join(kept)}' AS branches, {repr(gone) if gone else 'NULL'} AS removed, {' + '.join(f'l_{b}' for b in kept)} AS x FROM lineitem" for name, kept, gone in ablation.variants(_BRANCHES)]
    return f"WITH v AS ({' UNION ALL '.join(each)}) SELECT variant, branches, removed, count(*) AS n_values, round(sum(x), 2) AS total FROM v GROUP BY ALL"


@query(_variants_sql())
def ablation_variants(spark, sf_dir):
    """What each variant keeps of all events: its branches, hits and the sum of their values."""
    events = fx.ragged(spark, sf_dir)
    table = ablation.variants_table(spark, [b for b in events.columns if b in _BRANCHES])  # a row a variant
    values = events.select(F.explode(F.arrays_zip(*_BRANCHES)).alias("h")).crossJoin(F.broadcast(table))
    kept = F.lit(0.0)
    for b in _BRANCHES:
        kept = kept + F.when(F.array_contains("branches", b), F.col(f"h.{b}")).otherwise(0.0)
    grouped = values.groupBy("variant", F.array_join("branches", ",").alias("branches"), "removed").agg(F.count("*").alias("n_values"), F.sum(kept).alias("total"))
    return rounded(grouped, "total", digits=2)


def _ablation_sql() -> str:
    parts = []
    names = ", ".join(f"('{name}', '{removed or ''}', '{';'.join(kept)}', {len(kept)})" for name, kept, removed in ablation.variants(_BRANCHES))
    for name, kept, _ in ablation.variants(_BRANCHES):
        k = len(kept)
        cells = ", ".join(f"{{'slot': i * {k} + {j}, 'value': l_{b}}}" for j, b in enumerate(kept))
        parts.append(f"SELECT '{name}' AS variant, evt, sum((value - floor(value)) * (value - floor(value))) FILTER (slot < 12) / 12 AS score FROM (SELECT evt, unnest([{cells}], recursive := true) FROM lines) GROUP BY evt")
    return f"""WITH {fx.SQL_LINES}, v AS ({" UNION ALL ".join(parts)})
SELECT variant, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std, round(min(score), 9) AS min, round(max(score), 9) AS max, round(avg((score >= 0.0005)::INT), 9) AS fraction, count(*) AS n,
round(quantile_cont(score, 0.5), 9) AS p50, round(quantile_cont(score, 0.95), 9) AS p95, round(quantile_cont(score, 0.99), 9) AS p99, round(avg(score), 9) AS eval_loss, any_value(removed) AS removed, any_value(branches) AS branches, any_value(n_branches) AS n_branches
FROM v JOIN (VALUES {names}) b(variant, removed, branches, n_branches) USING (variant) GROUP BY variant"""


@query(_ablation_sql())
def ablation_summary(spark, sf_dir):
    error = lambda x: vec.mse(x, F.transform(x, lambda e: F.floor(e).cast("double")))
    scores = ablation.variant_scores(fx.ragged(spark, sf_dir), _BRANCHES, lambda v: vec.bound(v, error), 12, ["evt"])
    return rounded(ablation.summary(scores, 0.0005, _BRANCHES), "mean", "std", "min", "max", "fraction", "p50", "p95", "p99", "eval_loss", digits=9)


_FILES = "f AS (SELECT '/data/DQM_' || c_name || '.root' AS path, c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') AS good FROM customer)"


@query(f"""WITH {_FILES}, g AS (SELECT path, row_number() OVER (ORDER BY md5('0|' || path), path) - 1 AS place, count(*) OVER () AS n FROM f WHERE good)
SELECT path, CASE WHEN place < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split, 0 AS label FROM g UNION ALL SELECT path, 'test', 1 FROM f WHERE NOT good""")
def train_test_files(spark, sf_dir):
    paths, runs = fx.files(spark, sf_dir)
    return splits.train_test_files(splits.data_files(paths), runs)


@query("""WITH s AS (SELECT c_custkey::BIGINT AS key, row_number() OVER (ORDER BY md5('42|' || c_custkey), c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer) SELECT key, place >= n - round_even(n * 0.1, 0) AS is_validation FROM s""")
def validation_split(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key"))
    return splits.validation_split(rows, "key", 0.1)


@query("""WITH k AS (SELECT c_custkey::BIGINT AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS place, count(*) OVER () AS n FROM customer), d AS (SELECT unnest(range(0, 4 * n)) AS draw, n FROM (SELECT DISTINCT n FROM k))
SELECT draw, key FROM d JOIN k ON k.place = ('0x' || substr(md5('0|' || draw), 1, 13))::BIGINT % d.n""")
def bootstrap_sample(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key"))
    return splits.bootstrap(rows, "key", 4 * rows.count()).select("draw", "key")


@query("""SELECT 'posWire_' || CASE p_partkey % 4 WHEN 0 THEN 'U' WHEN 1 THEN 'V' WHEN 2 THEN 'Y' ELSE 'Q' END || '_' || p_partkey AS name, p_size::DOUBLE AS x, p_retailprice AS y, (p_partkey % 7)::DOUBLE AS z,
CASE WHEN p_partkey % 4 < 3 THEN p_partkey % 4 END::INT AS plane, p_partkey::INT AS channel, p_partkey::INT AS wire FROM part""")
def wire_positions(spark, sf_dir):
    letter = F.element_at(F.array(*map(F.lit, "UVYQ")), (F.col("p_partkey") % 4).cast("int") + 1)
    xml = F.format_string('<position name="posWire_%s_%d" x="%d" y="%s" z="%d"/>', letter, "p_partkey", "p_size", F.col("p_retailprice").cast("string"), F.col("p_partkey") % 7)
    return geometry.parse_positions(fx.table(spark, sf_dir, "part").select(xml.alias("xml")), "xml", prefix="posWire_")


# --- streams ----------------------------------------------------------------------------------------------------


def _event_stream(spark, sf_dir) -> DataFrame:
    """The events as a stream: of the part files where the table is a folder, else of the single file among the others."""
    path, schema = f"{sf_dir}/events.parquet", fx.table(spark, sf_dir, "events").schema
    if is_folder(spark, path):
        return jobs.read_stream(spark, path, schema)
    return jobs.read_stream(spark, sf_dir, schema, pattern="events.parquet")


def _stream_rows(df: DataFrame) -> DataFrame:
    raw = F.array(F.col("value").cast("double"), (F.col("user_id") % 7).cast("double"), (F.col("event_id") % 5).cast("double"))
    return jobs.event_vectors(df.select(F.col("event_id").cast("long").alias("event_id"), raw.alias("raw")), "raw", 4)


def _streamed(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    out = scratch(spark, label)
    jobs.run_to_table(df, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


_STREAM = """r AS (SELECT event_id::BIGINT AS event_id, [value::DOUBLE, (user_id % 7)::DOUBLE, (event_id % 5)::DOUBLE, 0::DOUBLE] AS x FROM events),
l AS (SELECT event_id, unnest(range(0, 4))::INT AS slot, unnest(x) AS e FROM r), m AS (SELECT event_id, avg(e) AS m, stddev_pop(e) AS s FROM l GROUP BY event_id),
z AS (SELECT event_id, slot, CASE WHEN s > 1e-12 THEN (e - m) / s ELSE e END AS value FROM l JOIN m USING (event_id))"""


@query(f"WITH {_STREAM} SELECT event_id, slot, round(value, 6) AS value FROM z")
def stream_vectors(spark, sf_dir):
    made = _stream_rows(_event_stream(spark, sf_dir)).select("event_id", "x")
    return slots(_streamed(made, "vectors"), "event_id", "x")


@query(f"WITH {_STREAM} SELECT event_id, round(avg((value - 0.5) * (value - 0.5)), 6) AS score FROM z GROUP BY event_id")
def stream_scores(spark, sf_dir):
    made = _stream_rows(_event_stream(spark, sf_dir))
    scored = predict.score_vectors(made, "x", lambda x: np.full_like(x, 0.5)).select("event_id", "score")
    return rounded(_streamed(scored, "scores"), "score")


_STREAM_LAYOUT = Layout(20, 10, 2, 4)


@query(f"""WITH ih AS (SELECT event_id // 10 AS event_idx, user_id::BIGINT AS channel, value::DOUBLE AS integral FROM events), nw AS (SELECT (max(event_idx) + 1 - 60) // 10 + 1 AS nw FROM ih),
starts AS (SELECT DISTINCT k * 10 + w * 20 AS frame_start FROM (SELECT unnest(range(0, nw)) AS k FROM nw), (SELECT unnest(range(0, 3)) AS w))
SELECT frame_start, channel, {fx.sql_bin("event_idx - frame_start", _STREAM_LAYOUT)} AS bin, round(sum(integral), 6) AS sum, count(*) AS cnt, min(integral) AS min, max(integral) AS max FROM starts JOIN ih ON event_idx >= frame_start AND event_idx < frame_start + 20 GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """Frames of events that arrive in parts, each part in a run of its own that goes on from the state the last one left."""
    folder, table = scratch(spark, "windows"), fx.table(spark, sf_dir, "events")
    newest = table.agg(F.max("event_id")).first()[0]
    n = 0 if newest is None else newest // 10 + 1
    schema = "event_idx long, channel long, integral double"
    parts = max(2, -(-n // 1_000_000))
    for i in range(parts):
        # by ranges of the table's own column, which the files' statistics know: no arrival reads the others' row groups
        arrived = table.filter(F.col("event_id").between(n * i // parts * 10, n * (i + 1) // parts * 10 - 1))
        arrived.select((F.col("event_id") / 10).cast("long").alias("event_idx"), F.col("user_id").cast("long").alias("channel"), F.col("value").cast("double").alias("integral")).write.mode("append").parquet(f"{folder}/in")
        frames.run_frames(jobs.read_stream(spark, f"{folder}/in", schema, files_per_batch=None), _STREAM_LAYOUT, f"{folder}/out", f"{folder}/checkpoint")
    return rounded(frames.whole_frames(spark, f"{folder}/out", _STREAM_LAYOUT, n).select("frame_start", "channel", "bin", "sum", "cnt", "min", "max"), "sum")

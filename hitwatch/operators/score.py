"""Forecast errors, window and event scores, alerts, event joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hitwatch.functions.names import fresh
from hitwatch.functions.vectors import mse
from hitwatch.operators import graph
from hitwatch.operators.windows import DEFAULT_FEATURES, Layout, check_features

#: Weight of each past frame in the built-in forecasts.
FORECASTS = {
    "persistence": lambda w, history: F.when(w == history - 1, 1.0).otherwise(0.0),
    "history_mean": lambda w, history: F.lit(1.0 / history),
}


def forecast_node_scores(assembled: DataFrame, layout: Layout, n_windows: int, features: Sequence[str] = DEFAULT_FEATURES, forecast: str = "persistence", least: float = 1e-6) -> DataFrame:
    """(window_id, channel, mse) of the active nodes: mean squared error over the target's bins and features.

    Forecast and target are linear in the frames, so one grouped sum of weighted frames gives the differences,
    and the past's activity with them. Rows are dealt by window once; all sums, and the choice of channel 0 for
    windows without activity, happen there.
    """
    if forecast not in FORECASTS:
        raise ValueError(f"unknown forecast {forecast}; one of {sorted(FORECASTS)}")
    check_features(features)
    w = F.col("w")
    weight = F.when(w == layout.history, -1.0).otherwise(FORECASTS[forecast](w, layout.history))
    activity = F.when(w < layout.history, graph.feature_size(features)).otherwise(0.0)
    dealt = assembled.select("window_id", "channel", "bin", weight.alias("_w"), activity.alias("_a"), *features).repartition("window_id")
    cells = dealt.groupBy("window_id", "channel", "bin").agg(F.sum("_a").alias("_a"), *[F.sum(F.col("_w") * F.col(f)).alias(f) for f in features])
    square = F.lit(0.0)
    for f in features:
        square = square + F.col(f) * F.col(f)
    nodes = cells.groupBy("window_id", "channel").agg((F.sum("_a") > least).cast("int").alias("_real"), F.sum(square).alias("_sq")).filter("_real = 1 OR channel = 0")
    spare = assembled.sparkSession.range(n_windows).select(F.col("id").alias("window_id"), F.lit(0).cast("long").alias("channel"), F.lit(0).alias("_real"), F.lit(0.0).alias("_sq"))
    of = W.partitionBy("window_id")
    ranked = nodes.union(spare).select("*", F.row_number().over(of.orderBy(F.desc("_real"), "channel", F.desc("_sq"))).alias("_r"), F.sum("_real").over(of).alias("_m"))
    return ranked.filter("_real = 1 OR (_m = 0 AND _r = 1)").select("window_id", "channel", (F.col("_sq") / (layout.bins * len(features))).alias("mse"))


def window_scores(node_scores: DataFrame) -> DataFrame:
    """(window_id, score_mean, score_max, n_nodes)."""
    return node_scores.groupBy("window_id").agg(F.avg("mse").alias("score_mean"), F.max("mse").alias("score_max"), F.count("*").alias("n_nodes"))


def score_column(mode: str) -> Column:
    """Column of the chosen window score."""
    if mode not in ("mean", "max"):
        raise ValueError(f"score mode must be mean or max, not {mode}")
    return F.col(f"score_{mode}")


def flag(score: Column, threshold: float | None) -> Column:
    """Anomaly flag: strictly over the threshold."""
    if threshold is None:
        raise ValueError("a threshold is needed to flag anomalies")
    return score > F.lit(float(threshold))


def anomaly_fraction(scores: DataFrame, threshold: float, column: str = "score") -> DataFrame:
    """One row: share of scores at or over the threshold; NaN without scores."""
    return scores.agg(F.coalesce(F.avg((F.col(column) >= threshold).cast("double")), F.lit(float("nan"))).alias("fraction"))


def channel_mse(node_scores: DataFrame, n_channels: int) -> DataFrame:
    """(channel, mse): mean over the windows; null for channels that were never active."""
    means = node_scores.groupBy("channel").agg(F.avg("mse").alias("mse"))
    return node_scores.sparkSession.range(n_channels).select(F.col("id").alias("channel")).join(means, "channel", "left")


def score_grid(runs: DataFrame) -> DataFrame:
    """(window_id, channel, mse) of every channel, from runs (window_id, first, last, channel, mse) of a node and the channels around it that were inactive.

    Rows are made where their run is: nothing is joined or exchanged. They are windows x channels.
    """
    rows = runs.withColumn("_at", F.explode(F.sequence("first", "last")))
    return rows.select("window_id", F.col("_at").alias("channel"), F.when(F.col("_at") == F.col("channel"), F.col("mse")).alias("mse"))


def reconstruction_scores(df: DataFrame, x: str, x_hat: str, out: str = "score") -> DataFrame:
    """Mean squared reconstruction error of each row's vector."""
    return df.withColumn(out, mse(F.col(x), F.col(x_hat)))


def join_events(left: DataFrame, right: DataFrame, keys: Mapping[str, str] | Sequence[str] = ("run", "subrun", "evt")) -> DataFrame:
    """Inner join of two sub-detectors' events; ``keys`` may name the right side's columns. Null keys never match."""
    names = dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}
    renamed = right.select(*[F.col(c).alias(next((k for k, v in names.items() if v == c), c)) for c in right.columns])
    return left.join(renamed, list(names))


def pair_by_position(left: DataFrame, right: DataFrame, order: str) -> DataFrame:
    """Rows of equal place in the order of a column of either side; both must have as many rows."""
    from hitwatch.operators.index import with_global_index

    if left.count() != right.count():
        raise ValueError("both sides must have as many rows")
    (place,) = fresh([*left.columns, *right.columns, *[f"right_{c}" for c in right.columns]], "_place")
    a, b = (with_global_index(d, [F.col(order)], place) for d in (left, right))
    return a.join(b.select(place, *[F.col(c).alias(f"right_{c}") for c in right.columns]), place).drop(place)


def with_labels(rows: DataFrame, labels: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the columns of ``labels``, null where a key has none."""
    return rows.join(labels, list(keys), "left")


def multi_branch(branches: Mapping[str, DataFrame], thresholds: Mapping[str, float | None], keys: Sequence[str] = ("run", "subrun", "evt")) -> DataFrame:
    """Largest score and alert of events over branches with a ``score`` column each.

    A branch that lacks an event scores 0 there; the alert is that any branch is strictly over its threshold,
    branches without one are never over.
    """
    out: DataFrame | None = None
    for name, scores in branches.items():
        own = scores.select(*keys, F.col("score").alias(f"{name}_score"))
        out = own if out is None else out.join(own, list(keys), "full_outer")
    if out is None:
        raise ValueError("no branch")
    names = list(branches)
    filled = out.select(*keys, *[F.coalesce(f"{n}_score", F.lit(0.0)).alias(f"{n}_score") for n in names])
    over = F.lit(False)
    for n in names:
        if thresholds.get(n) is not None:
            over = over | (F.col(f"{n}_score") > float(thresholds[n]))
    top = F.greatest(*[f"{n}_score" for n in names]) if len(names) > 1 else F.col(f"{names[0]}_score")
    return filled.withColumn("max_score", top).withColumn("alert", over)


def dual_rule(scores: DataFrame, threshold: float) -> DataFrame:
    """Alert where the largest node score is over the threshold or the mean over half of it."""
    return scores.withColumn("alert", (F.col("score_max") > threshold) | (F.col("score_mean") > 0.5 * threshold))


def top_windows(scores: DataFrame, k: int, mode: str = "max") -> DataFrame:
    """The ``k`` windows with the largest scores."""
    return scores.orderBy(score_column(mode).desc(), "window_id").limit(k)


def weighted_mean_loss(batches: DataFrame, loss: str = "loss", n: str = "n") -> DataFrame:
    return batches.agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("mean_loss"))
